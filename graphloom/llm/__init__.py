"""Training-data operators (text, pages, conversations). Nothing outside this subpackage imports it."""
