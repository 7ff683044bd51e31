"""Parsers that tell whether a source text is well formed: recursive descent for statements, precedence climbing for
expressions, panic-mode recovery so that one error does not hide the next."""
