"""Column functions: text as CPython sees it, document identity, cleaning, HTML, URLs."""
