"""Names that the tests of this folder share."""
import public_tokenizers

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def key(*values):
    """Sorts with nulls."""
    return tuple((v is not None, v) for v in values)
