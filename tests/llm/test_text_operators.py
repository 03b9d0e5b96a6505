"""Substring dedup, Jaccard join, byte pairs, language: against plain versions, with awkward rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import bpe, jaccard_join, langid, substring_dedup, words
from skyledger.llm.filters import with_possible
from tests.llm.common import awkward, documents, jaccard_components, prose, removed_words

SF = "/root/testdata/sf0.001"


def unique(rows):
    seen, out = set(), []
    for r in rows:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out


def copies_and_edits(seed, n=60):
    """Texts that are copied, edited, cut and glued from each other."""
    rng = random.Random(seed)
    texts = [prose(seed + k, rng.randrange(1, 120), 12) for k in range(n // 3)]
    while len(texts) < n:
        a, b = rng.choice(texts).split(), rng.choice(texts).split()
        kind = rng.randrange(4)
        if kind == 0:
            a[rng.randrange(len(a))] = "edit"
        elif kind == 1:
            a = a[rng.randrange(len(a)):] + b[:rng.randrange(len(b) + 1)]
        elif kind == 2:
            a = a + a
        texts.append(" ".join(a))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_word_hashes_follow_the_words():
    raws = [x.encode() for x in ("", " a  b\ta ", "a", "\x0b\x0c\r\n", "b\x1ca é é")]
    hashes, at = words.word_hashes(raws)
    plain = [w for raw in raws for w in raw.split()]
    assert np.diff(at).tolist() == [len(raw.split()) for raw in raws]
    assert [[a == b for b in hashes] for a in hashes] == [[a == b for b in plain] for a in plain]


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_matches_reading_all_windows(spark, seed):
    rows = copies_and_edits(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = removed_words(rows)
    for r in substring_dedup.dedup(docs, digest=True).collect():
        n, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_substring_dedup_on_awkward_rows(spark):
    rows = unique(awkward())
    got = {r.doc_id: r for r in substring_dedup.dedup(documents(spark, rows)).collect()}
    want = removed_words([r[:2] for r in rows])
    assert {i: (r.n_words, r.kept_text) for i, r in got.items()} == {i: (n, b" ".join(k).decode()) for i, (n, k) in want.items()}
    everything = substring_dedup.dedup(documents(spark, awkward())).collect()
    assert len(everything) == len(awkward())
    assert [r.n_removed for r in everything if r.n_words == 1] == [0, 0, 0][:sum(r.n_words == 1 for r in everything)]
    assert substring_dedup.dedup(documents(spark, [])).collect() == []


def test_substring_dedup_keeps_a_repeated_row_and_counts_negative_ids(spark):
    rows = [(i - 30, t) for i, t in copies_and_edits(5)]
    want = {i: (n, b" ".join(kept).decode()) for i, (n, kept) in removed_words(rows).items()}
    long = [r for r in rows if len(r[1].split()) > 20][::3]
    for frame in (rows, rows + long + long[:2]):
        got = substring_dedup.dedup(spark.createDataFrame(frame, "doc_id long, text string").repartition(5)).collect()
        assert len(got) == len(frame) and all((r.n_words, r.kept_text) == want[r.doc_id] for r in got)


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_components_match_all_pairs(spark, seed):
    rows = copies_and_edits(seed, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(docs).collect()}
    assert got == jaccard_components(rows)


def test_jaccard_on_a_large_group_of_near_copies(spark):
    base = prose(9, 60, 30).split()
    rows = [(k, " ".join([*base[:k % 55], f"e{k}", *base[k % 55 + 1:]])) for k in range(120)] + [(500 + k, prose(100 + k, 50)) for k in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_components(rows)


def test_jaccard_of_near_copies_beside_a_longer_text_with_the_least_key(spark):
    one, others = prose(50, 100).split(), [prose(51 + k, 100) for k in range(3)]
    near = [" ".join(one), " ".join([*one[:50], "changed", *one[51:]])]

    def key(text):
        return jaccard_join.set_key(jaccard_join.shingle_sets([text.encode()])[0])

    glued = next(t for k in range(200) if key(t := " ".join([near[0], *others, f"end{k}"])) < min(map(key, near)))
    rows = [(0, near[0]), (1, near[1]), (2, glued)] + [(10 + k, others[k % 3]) for k in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_components(rows) and got[1][1] == 0


def test_only_texts_with_a_close_partner_are_moved(spark, monkeypatch):
    """Texts of one size that share a passage too short for a link stay where they are; near copies meet."""
    moved, whole = [], jaccard_join.set_parts

    def watched(rows, *rest):
        moved.extend(r.key for r in rows.select("key").distinct().collect())
        return whole(rows, *rest)

    monkeypatch.setattr(jaccard_join, "set_parts", watched)
    passage, near = prose(70, 12), prose(90, 100).split()
    rows = [(k, f"{passage} {prose(71 + k, 100)}") for k in range(8)] + [(20, " ".join(near)), (21, " ".join([*near[:50], "changed", *near[51:]]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == jaccard_components(rows) and got[21][1] == 20
    keys = {jaccard_join.set_key(s) for s in jaccard_join.shingle_sets([t.encode() for _, t in rows[8:]])}
    assert set(moved) == {int(jaccard_join.signed([k])[0]) for k in keys}


def test_the_filter_clears_most_rows_and_no_wanted_one(spark):
    rows, wanted = spark.range(20_000).withColumnRenamed("id", "uid"), spark.range(0, 20_000, 100).withColumnRenamed("id", "uid")
    hashed = F.xxhash64("uid")
    flagged = {r.uid for r in with_possible(rows, hashed, wanted, hashed, "flag").filter("flag").collect()}
    assert set(range(0, 20_000, 100)) <= flagged and len(flagged) < 250
    left = corpus_pipeline.without(rows, wanted, "uid")
    assert sorted(r.uid for r in left.collect()) == [k for k in range(20_000) if k % 100]
    assert corpus_pipeline.without(rows, wanted.limit(0), "uid").count() == 20_000


def test_jaccard_on_awkward_rows(spark):
    rows = unique(awkward())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(documents(spark, rows)).collect()}
    assert got == jaccard_components([r[:2] for r in rows])
    assert jaccard_join.join_components(documents(spark, awkward())).count() == len(awkward())
    assert jaccard_join.join_components(documents(spark, [])).collect() == []


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return bpe.Vocabulary.read(public_tokenizers.path("word_bpe_49k.json"))


def test_byte_pairs_match_the_library(spark, vocabulary):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    odd = ["don't WE'LL", "<|endoftext|>x<|ENDOFTEXT|>", "ΑΣ ΟΔΟΣ", "İ ǅ ﬁ é", "a\x1cb\x85c", "日本語 ٣ ½", "z" * 2000, "\x00 \x7f"]
    rows = [*awkward(), *((100 + k, t, "en", "a") for k, t in enumerate(odd))]
    docs = documents(spark, rows).withColumn("row", F.monotonically_increasing_id())
    ids = {r.row: r.ids for r in bpe.encode(docs, vocabulary, id_col="row").collect()}
    texts = {r.row: r.text or "" for r in docs.select("row", "text").collect()}
    want = {k: library.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    assert ids == want
    encoded = bpe.encode(docs, vocabulary, id_col="row")
    assert {r.row: r.decoded for r in bpe.decode(encoded, vocabulary, id_col="row").collect()} == {k: library.decode(v, skip_special_tokens=False) for k, v in want.items()}
    for r in bpe.round_trip(docs, vocabulary, id_col="row").collect():
        assert r.n_tokens == len(want[r.row])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.row])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want[r.row], skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(documents(spark, []), vocabulary).collect() == []


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.filter("NOT held_out"))
    rows = langid.predict(docs, model, keep=("doc_id", "held_out", "lang")).filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_language_on_awkward_rows(spark):
    docs = documents(spark, awkward())
    rows = langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (5, 6, 7))
    nothing = langid.fit(documents(spark, []))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(documents(spark, []), nothing).collect() == []
