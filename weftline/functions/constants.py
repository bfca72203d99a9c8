"""Fixed values shared by the operators."""

# Reserved token ids.
UNK_ID = 0
BOS_ID = 1
EOS_ID = 2
PAD_ID = 3
IGNORE_ID = -1

# The tokens of the reserved ids.
SPECIAL_TOKENS = {"<unk>": UNK_ID, "<s>": BOS_ID, "</s>": EOS_ID, "<pad>": PAD_ID}

# Byte tokens follow the four special tokens, pieces follow the byte tokens.
FIRST_BYTE_ID = 4
FIRST_PIECE_ID = FIRST_BYTE_ID + 256

# Training defaults.
SHUFFLE_SEED = 42
DEFAULT_VOCAB_SIZE = 32768
CHARACTER_COVERAGE = 0.9995

# Marks that reject a web document.
REJECTED_WARNINGS = ["noisy", "header", "footer", "short_sentences", "tiny", "adult"]

# Special tokens left out of vocabulary transfer.
TRANSFER_SPECIALS = ["<s>", "</s>", "<unk>", "<pad>", "<mask>"]

# Marks the first piece of a word.
WORD_MARK = "▁"

# White space as str.isspace defines it: 29 code points, the last is U+3000.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
