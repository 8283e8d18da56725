"""Texts that are easy to get wrong."""

HARD = [
    None, "", "a", "  a", "a  b\n \n c   ", "\n\n x", " \n", "x \n\t y", "<|endoftext|>", "hi <|endoftext|>  yo<|endoftext|>\n z",
    "<|startoftext|>ab", "a\x1cb \x1d", "x\xa0y 　 z　 w", "ÀÉ ﬁ é " + "a" * 300, "ab" * 90 + " " * 70 + "!" * 99, "don't I'LL we'll",
    "日本語 텍스트 \U0001f600\U0001f600", "    a", " ", "   ", "\r\n\r\n a", "ΑΣ σ", "it's " * 50,
    "the same words again and again the same words again and again", "the same words again and again the same words again and again",
    "line one here\nline one here\n\n\nline two", "word " * 4000,
]
