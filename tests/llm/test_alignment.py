import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from turnwise.llm import alignment
from turnwise.llm.alignment import align_documents, byte_level_vocabulary, common_places, gallop, piece_vocabulary

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Libraries:
    """Whole texts by the libraries, ends compared as sets."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(PATH_A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
        vocabularies = byte_level_vocabulary(PATH_A), piece_vocabulary(PATH_B)
        self.bytes = [[v.tokens.rows(np.array([i]))[0].tobytes() for i in range(v.size)] for v in vocabularies]

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = (" " + text).encode()
        if any(b"".join(table[i] for i in ids) != whole for table, ids in zip(self.bytes, (a, b), strict=True)):
            return []
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in zip(self.bytes, (a, b), strict=True)]
        out, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            at_a, at_b = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            out.append((a[i:at_a], b[j:at_b]))
            i, j = at_a, at_b
        return out

    def rows(self, texts):
        groups = [self.groups(t) for t in texts]
        counts = Counter((x[-1], y[-1]) for g in groups for x, y in g)
        highest = Counter()
        for (_, b), n in counts.items():
            highest[b] = max(highest[b], n)
        out = []
        for g in groups:
            links = [(x[-1], y[-1]) for x, y in g]
            written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
            out.append(
                (
                    sum(len(x) for x, _ in g),
                    sum(len(y) for _, y in g),
                    len(g),
                    len(links),
                    sum(counts[k] == highest[k[1]] for k in links),
                    sum(counts[k] for k in links),
                    hashlib.sha256(written.encode()).hexdigest() if g else "",
                )
            )
        return out


@pytest.fixture(scope="module")
def libraries():
    return Libraries()


def results(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, *[r[f] for f in FIELDS]) for r in df.collect())


def expected(libraries, rows):
    found = libraries.rows([t for _, t in rows])
    return sorted((-1 if i is None else i, *x) for (i, _), x in zip(rows, found, strict=True))


@pytest.mark.parametrize("large", [1, 64, 1 << 20])  # few, some and all pairs in the broadcast
def test_whole_texts_by_the_libraries(spark, documents, libraries, large):
    rows = [(r.doc_id, r.text) for r in documents.limit(60).collect()]
    got = align_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH_A, PATH_B, large=large)
    assert results(got) == expected(libraries, rows)


def test_odd_rows(odd, libraries):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert results(align_documents(odd, PATH_A, PATH_B)) == expected(libraries, rows)


def test_white_space_special_tokens_and_other_scripts(spark, libraries):
    texts = [
        "  two  spaces   at \n all  places ",
        "<|endoftext|> and <s> are text </s>",
        "▁ is no space",
        "日本語 のテキスト 😀👍🏽 \x00 ​  x \x1c y\x85z",
        "a\tb\r\nc d",
        " ",
        "x" * 5000 + " " + "é" * 3000,
        "don't we'll I'm they're 'tis 's",
        "1234567 89.5e-10 3,000",
    ]
    rows = list(enumerate(texts))
    got = align_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH_A, PATH_B)
    assert results(got) == expected(libraries, rows)


def test_full_table_forgets_rare_pieces_and_changes_nothing(documents, libraries, monkeypatch):
    import pyarrow as pa

    texts = [r.text for r in documents.limit(40).collect()]
    table = alignment.PieceAlignments(byte_level_vocabulary(PATH_A), piece_vocabulary(PATH_B))
    monkeypatch.setattr(alignment, "CACHE", 300)
    shas = [alignment.aligned_slice(pa.array([t or ""]), table)["groups_sha256"][0].as_py() for t in texts * 2]
    assert shas == [x[-1] for x in libraries.rows(texts)] * 2


def test_spans_give_the_groups(spark, libraries):
    text = "an unalignable enthronement of lexicographers"
    row = align_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH_A, PATH_B, spans=True).first()
    a = np.split(row.ids_a, np.cumsum(row.sizes_a)[:-1])
    b = np.split(row.ids_b, np.cumsum(row.sizes_b)[:-1])
    assert [(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)] == libraries.groups(text)


def test_empty_table_and_clashing_names(spark, empty):
    assert align_documents(empty, PATH_A, PATH_B).count() == 0
    rows = spark.createDataFrame([(1, "a b", 7, 8, "z")], "doc_id long, text string, n_a int, row int, pairs string")
    got = align_documents(rows, PATH_A, PATH_B, carry=("doc_id", "n_a", "row", "pairs")).first()
    assert (got.n_a, got.row, got.pairs) == (2, 8, "z")


def test_galloping():
    random = np.random.default_rng(5)
    for n, m in [(0, 5), (5, 0), (1, 1), (70, 9000), (9000, 70), (500, 500), (4000, 4100)]:
        a = np.unique(random.integers(0, 20000, n))
        b = np.unique(random.integers(0, 20000, m))
        assert gallop(a, b).tolist() == np.searchsorted(b, a).tolist()
        i, j = common_places(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
