import hashlib
import random

from inkwell.llm import chat, registry

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_escapes_come_back():
    rng = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", " ", "INST]", "x", "\n"]
    for _ in range(500):
        turns = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 5))), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(0, 4))]
        done = chat.format_turns(turns, learned=tuple({r for r, _ in turns}))
        assert chat.turns_of(done.text) == turns
        assert [chat.unescape(done.text[a:b]) for a, b in done.mask] == [t for _, t in turns]
        assert done.spans == [] or done.spans[-1][1] == len(done.text)


def test_rewriting_templates_are_seen():
    def late_system(turns):  # puts system texts beside the last user turn
        system = " ".join(t for r, t in turns if r == "system")
        last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
        return "".join(f"|{r}:{system + ' ' if i == last else ''}{t}" for i, (r, t) in enumerate(turns) if r != "system")

    turns = [("system", "be kind"), ("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes")]
    done = chat.format_turns(turns, late_system)
    assert done.rewritten_at == 3 and done.spans == []
    assert [done.text[a:b] for a, b in done.mask] == ["hello", "yes"]
    assert chat.format_turns(turns[:3], late_system).rewritten_at == -1


def conversations():
    rng = random.Random(2)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t} " + "é[INST]" * rng.randint(0, 3), "clash") for c in range(40) for t in range(rng.randint(1, 9))]
    rng.shuffle(rows)
    return rows + [(100, 0, None, None, ""), (101, 1, "assistant", None, ""), (101, 0, "user", "</s>", ""), (102, 5, "assistant", "b", ""), (102, 5, "assistant", "a", ""), (102, 5, "assistant", "a", ""), (None, 0, "user", "x", ""), (103, None, "assistant", "first", ""), (103, 0, "assistant", "then", ""), (104, 0, "assistant", "long " * 50_000, "")]


def expected(rows):
    said = "</s>[INST] ok [/INST]"
    by = {-7: [(0, "user", said), (1, "assistant", said)]}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out.append((c, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.render([(r, x) for _, r, x in turns]))))
    return sorted(out, key=str)


def test_query(spark, tmp_path):
    for k, rows in enumerate((conversations(), [])):
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/{k}/conversations.parquet")
        got = registry.queries()["op10_chat"](spark, f"{tmp_path}/{k}").collect()
        assert sorted(map(tuple, got), key=str) == expected(rows)


def last_user_system(turns):  # puts system texts beside the last user turn
    system = " ".join(t for r, t in turns if r == "system")
    last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=-1)
    return "".join(f"|{r}:{system + ' ' if i == last else ''}{t}" for i, (r, t) in enumerate(turns) if r != "system")


def test_all_rewrites_are_seen_and_all_turns_located(spark):
    turns = [("system", "be kind"), ("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes"), ("user", "bye"), ("system", "be brief")]
    done = chat.format_turns(turns, last_user_system)
    assert done.rewritten == [3, 5, 6] and done.rewritten_at == 3
    assert [done.text[a:b] for a, b in done.located] == [t for _, t in turns]
    plain = chat.format_turns(turns[:3])
    assert plain.rewritten == [] and [plain.text[a:b] for a, b in plain.located] == [t for _, t in turns[:3]]
    rows = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(rows).first()
    assert [got["formatted"][x["begin"] : x["end"]] for x in got["located"]] == [t for _, t in turns] and got["rewritten"] == []
