"""Texts that are hard to split, encode or normalise."""

ODD_TEXTS = [
    None, "", " ", "\n", "a", "hello  world\n\n x", " lead", "trail ", "tab\tsep \t x", "x <|endoftext|> y<|endoftext|>",
    "<|startoftext|>a", "nb sp   a", " line  sep\x85next", "é combining ́x", "Ünïcode ÇA ΣΑΣ ΣΑΣ.",
    "it's we'll I'M 'S", "emoji 😀 👩‍👩‍👧 x", "日本語 テキスト 中文", "1234 567,89", "a\x00b \x1c c\x1f", "İstanbul ǅ ﬁ",
    "word " * 3000, "x" * 5000, "\r\n windows\r\nlines", "–—… “quotes”", "ab\n cd \n ef\n\n\ngh", "ﬃ​ zero​width ﻿ bom",
]
