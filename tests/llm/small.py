"""Small tables with every awkward case."""


def documents():
    """(doc_id, text, source): nulls, empties, ties, repeated rows, odd characters, a long text."""
    return [
        (1, "The quick brown fox jumps over the lazy dog near the river bank", "src1"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank", "src1"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank", "src1"),
        (3, "the QUICK brown fox\tjumps\nover the lazy dog near the river bank", None),
        (4, "", "src2"), (5, None, "src2"), (6, " \t\n\x0b\x0c\r ", "src2"), (7, "one", None),
        (8, "één twee drie vier vijf — zes   zeven ß İ ſ", "src3"),
        (None, "a row without an id", "src3"), (None, None, None),
        (9, "long " * 30_000 + "end", "src1"), (10, "x" * 100_000, "src9"), (11, "one two", ""),
        (12, "emoji 😀 mix 日本語 テキスト é ligature ﬁ", "src3"),
    ]


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
