"""Column functions: text, markup, titles, dates, links."""
