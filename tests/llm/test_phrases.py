import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from turnwise.llm.phrase_mining import PhraseOptions, chunks_of, mine_phrases, parsed, phrase_counts, words_of

WORD = re.compile(r"[^\x20\x09]+")
PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [words for piece in PIECE.split((text or "").translate(LOWER)) if (words := WORD.findall(piece))]


def brute_force(rows, least=10, longest=3, percent=50, keep=2000):
    """Counts of all phrases in memory, then the rules one by one."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for words in pieces(text):
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in found.items():
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        around = [
            n for (other, longer), n in found.items()
            if other == lang and len(longer) > len(words)
            and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
        ]
        if not any(100 * n >= percent * a for n in around):
            out.append((lang, " ".join(words), a, left, right, totals[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    result = []
    for row in out:
        ranks[row[0]] += 1
        if ranks[row[0]] <= keep:
            result.append((row[0], ranks[row[0]], *row[1:]))
    return result


def mined(df, options=PhraseOptions()):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in mine_phrases(df, options).collect())


def random_rows(seed, n, vocabulary=12):
    random = np.random.default_rng(seed)
    words = ["a", "B", "cc", "é", "İx", "日本", "d-e", "x\x1cy", "f g", "'h", "i", "j"][:vocabulary]
    joins = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \x0b ", "?!", ":"]
    made = []
    for _ in range(n):
        size = int(random.integers(0, 120))
        text = "".join(words[i] + joins[j] for i, j in zip(random.integers(0, len(words), size), random.integers(0, len(joins), size), strict=True))
        made.append((random.choice(["en", "fr", "und"]).item(), text))
    return made + [(None, "a b a b a b " * 30), ("en", None), ("fr", ""), (None, " \n,. "), ("en", "x " * 900), *made[:5], *made[:5]]


def test_words_and_pieces():
    texts = ["", "Ab, cD\te", " .. ", "é É x\x1cy", "a", "z\n", "\na"]
    words = words_of(pa.array(texts, pa.large_string()))
    got = [[] for _ in texts]
    body = words.body.tobytes()
    for s, n, owner, begins in zip(words.starts, words.lengths, words.owner, words.begins, strict=True):
        if begins:
            got[owner].append([])
        got[owner][-1].append(body[s : s + n].decode())
    assert got == [pieces(t) for t in texts]


@pytest.mark.parametrize(("overlap", "spacing"), [(1, 1), (2, 1), (2, 3), (2, 32), (4, 5)])
def test_chunks_overlap_once_and_hold_the_text(overlap, spacing):
    texts = [t or "" for _, t in random_rows(1, 40)]
    chunks, owner = chunks_of(pa.array(texts, pa.large_string()), overlap, spacing)
    joined = [[] for _ in texts]
    for chunk, k in zip(chunks.to_pylist(), owner.tolist(), strict=True):
        words = re.split("[ \n]", chunk.removesuffix("\n"))
        joined[k] += words if chunk.endswith("\n") else words[:-overlap]
        assert chunk.endswith("\n") or len(words) > overlap
    assert joined == [[w for p in pieces(t) for w in p] for t in texts]


def test_chunks_depend_on_content_alone():
    passage = " ".join(f"w{i * i % 97}" for i in range(400))
    a = set(chunks_of(pa.array(["start here " + passage], pa.large_string()), 2, 8)[0].to_pylist())
    b = set(chunks_of(pa.array(["another and longer beginning of it " + passage], pa.large_string()), 2, 8)[0].to_pylist())
    assert len(a & b) >= 0.8 * len(a)


@pytest.mark.parametrize(
    "options",
    [
        PhraseOptions(),
        PhraseOptions(least=3, spacing=4, filter_bits=10, slices=3, keep=25),
        PhraseOptions(least=2, max_words=4, contained_percent=30),
        PhraseOptions(least=2, max_words=2),
    ],
)
def test_phrases_are_those_of_all_counts(spark, options):
    rows = random_rows(7, 60)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    wanted = brute_force(rows, options.least, options.max_words, options.contained_percent, options.keep)
    assert wanted and mined(df, options) == sorted(wanted)


def test_given_documents(documents):
    rows = [(r.lang, r.text) for r in documents.select("lang", "text").collect()]
    assert mined(documents) == sorted(brute_force(rows))


def test_dictionary_holds_each_chunk_once_with_its_frequency(spark):
    text = "one two three four five, six seven. " * 40
    df = spark.createDataFrame([("en", text)] * 30 + [("fr", text)], "lang string, text string").repartition(4)
    dictionary = parsed(df, PhraseOptions(spacing=4)).collect()
    assert len({(r.lang, r.chunk) for r in dictionary}) == len(dictionary)
    assert sum(r.times for r in dictionary if r.lang == "en") == 30 * sum(r.times for r in dictionary if r.lang == "fr")


def test_exact_scores_of_large_counts(spark):
    from turnwise.llm.phrase_mining import scored

    n = 9_000_000_000_000_001
    rows = [("en", 0, "", 10 * n), ("en", 1, "a", n), ("en", 1, "b", n + 2), ("en", 2, "a b", n - 3)]
    got = scored(spark.createDataFrame(rows, "lang string, words int, phrase string, n long"), PhraseOptions()).first()
    assert got.score == 1_000_000 * (n - 3) ** 2 // (n * (n + 2))


def test_results_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(random_rows(9, 50), "lang string, text string")
    counts = [sorted(map(tuple, phrase_counts(df.repartition(k), PhraseOptions(least=3)).collect())) for k in (1, 6)]
    assert counts[0] == counts[1]


def test_odd_rows_and_empty_tables(odd, empty):
    rows = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    assert mined(odd) == sorted(brute_force(rows))
    assert mined(empty) == []
