"""What the tests read from plans."""


def exchanges(frame):
    """The plan's exchanges, each by the columns that go through it."""
    found, left = [], [frame._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            left.append(node.inputPlan())
        if node.nodeName() == "Exchange":
            found.append(node.output().mkString(","))
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found
