"""Rows that no operator may stumble over."""

EDGES = [(0, None, None, None), (1, "", "en", "a"), (2, " \t\n ", "en", "a"), (3, "one", "en", None), (4, "one two", "en", "a"), (5, "One TWO", "de", "b"), (None, "lost and found again and again", "en", "a"), (7, "w " * 60_000 + "end", "en", "b"), (8, "same text here and there", "en", "a"), (8, "same text here and there", "en", "a")]
