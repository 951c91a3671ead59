"""Texts that every operator must take."""

ODD = [None, "", "   ", "a", "Ä", "one two three", "one two three", "\n\n", "x" * 5000, "w " * 3000, "tab\tand\x0bmore\x00nul", "𝒳 ▁ ｆ"]
