"""A tokenizer document whose tokens are those of the pattern, for tests of the adapter."""

from turnwise.operators import tokens


def _tokenizer_document(vocabulary: list[str]) -> str:
    from tokenizers import Regex, Tokenizer
    from tokenizers.models import WordLevel
    from tokenizers.pre_tokenizers import Split

    unknown = "\x00"  # never a token of the pattern's word class
    ids = {t: i for i, t in enumerate(vocabulary)} | {unknown: len(vocabulary)}
    tokenizer = Tokenizer(WordLevel(ids, unk_token=unknown))
    tokenizer.pre_tokenizer = Split(Regex(tokens.TOKEN_PATTERN), "removed", invert=True)
    return tokenizer.to_str()
