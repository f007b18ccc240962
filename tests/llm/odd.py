"""Texts that every operator has to take."""

ODD_TEXTS = [None, "", " ", "\n", "word", "a\n\n\nb", "é 中 😀 <|endoftext|> x\x1cy", "x " * 3000, "same text", "same text", "1" * 400]
