"""Cross-tokenizer alignment against a byte-by-byte brute force."""

import hashlib
import json
from collections import Counter

import pytest

from mailvane.llm import alignment
from mailvane.llm.alignment import alignment_report, token_groups
from mailvane.llm.queries import QUERIES

TEXTS = [
    (1, "The quick brown fox, the quick fox."),
    (2, None),
    (3, ""),
    (4, " lead and  two  spaces\t\n\n tabs "),
    (5, "Grüße an 漢字 und 🙂🙂 — naïve"),
    (6, "a▁b spelled with the space mark"),
    (7, "<|endoftext|> and <s> and <0x41> are plain"),
    (8, "The quick brown fox, the quick fox."),
    (8, "the same id again"),
    (None, "no id at all"),
    (9, "x" * 5000 + " " * 300 + "ab" * 4000),
    (10, " "),
    (11, "\x00nul\x00"),
]


@pytest.fixture(scope="module")
def tokenizers_of():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    vocabulary = {i: t for t, i in a.get_vocab().items()}
    byte = alignment._byte_of_character()

    def tokens(text):
        """Both sides as (id, bytes) of every token."""
        left = [(i, bytes(byte[c] for c in vocabulary[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        return left, right

    return tokens


def spans(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(texts, tokens_of):
    """Per row: id, groups and all overlapping pairs, byte by byte."""
    rows = []
    for who, text in texts:
        groups, links = [], []
        if text:
            left, right = tokens_of(text)
            raw = (" " + text).encode()
            if b"".join(t for _, t in left) == raw == b"".join(t for _, t in right):
                a, b = spans(left), spans(right)
                cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
                lo = 0
                for hi in cuts:
                    groups.append(([i for i, s, e in a if lo <= s < hi], [i for i, s, e in b if lo <= s < hi]))
                    lo = hi
                owner = {}
                for n, (_, s, e) in enumerate(b):
                    for at in range(s, e):
                        owner[at] = n
                for i, s, e in a:
                    links += [(i, b[n][0]) for n in sorted({owner[at] for at in range(s, e)})]
        rows.append((who, groups, links))
    count = Counter(p for _, _, links in rows for p in set(links))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for who, groups, links in rows:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append(
            (who, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
             sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest)
        )
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("hot_pairs", [alignment.HOT_PAIRS, 20])
def test_alignment_equals_brute_force(spark, tokenizers_of, hot_pairs):
    """Odd texts, with all pairs looked up, and with most of them joined."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    assert rows_of(alignment_report(docs, hot_pairs=hot_pairs)) == brute(TEXTS, tokenizers_of)


def test_alignment_query_on_a_table(spark, sf_dir, tokenizers_of):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op13_token_alignment"](spark, sf_dir)) == brute(texts, tokenizers_of)


def test_token_groups_spell_the_text(spark, tokenizers_of):
    docs = spark.createDataFrame([t for t in TEXTS if t[0] not in (None, 8)], "doc_id long, text string")
    found = {}
    for r in token_groups(docs).orderBy("doc_id", "group").collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert set(found) == {1, 4, 5, 7, 9, 10, 11}
    for who, text in TEXTS:
        if who in found:
            groups = found[who]
            assert [g["group"] for g in groups] == list(range(len(groups)))
            assert [g["start"] for g in groups] == [0, *[g["end"] for g in groups[:-1]]]
            assert groups[-1]["end"] == len(text.encode()) + 1
            left, right = tokenizers_of(text)
            assert [i for g in groups for i in g["a_ids"]] == [i for i, _ in left]
            assert [i for g in groups for i in g["b_ids"]] == [i for i, _ in right]


def test_side_a_is_the_vocabulary_file(tokenizers_of):
    """Merges by rank give the ids that the file's own library gives, on texts of many scripts."""
    import public_tokenizers

    side = alignment.ByteLevel(public_tokenizers.path(alignment.TOKENIZER_A))
    texts = [f"a{chr(c)}b 1{chr(c)}{chr(c)} {chr(c)}. {chr(c)}\n{chr(c)}x  {chr(c)}'s" for c in range(1, 0x3100, 7)]
    for text, ids in zip(texts, side.ids(texts)):
        assert ids.tolist() == [i for i, _ in tokenizers_of(text)[0]]


def test_vocabulary_out_of_merge_order_is_refused(tmp_path):
    model = {"vocab": {"a": 0, "b": 1, "ab": 3, "ba": 2}, "merges": ["a b", "b a"]}
    (tmp_path / "v.json").write_text(json.dumps({"model": model}))
    with pytest.raises(ValueError):
        alignment.ByteLevel(str(tmp_path / "v.json"))


def test_alignment_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment_report(empty).count() == 0 and token_groups(empty).count() == 0
    clashing = spark.createDataFrame(
        [(1, "a b", 7, 8, "x", [1], 2)], "doc_id long, text string, row long, code long, `n.best` string, codes array<int>, n int"
    )
    plain = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert rows_of(alignment_report(clashing, hot_pairs=1)) == rows_of(alignment_report(plain))
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(alignment_report(nothing)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
