"""Vectors, mixing, shards, rules, secrets, quality and the pipeline on small tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import graph, line_rules, mixing, nn_descent, quality, queries, secrets, sharding
from tests.compare import compare, connect
from tests.llm.common import Union, awkward, by_source, documents, prose

SF = "/root/testdata/sf0.001"


def test_every_numbered_query_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    result = compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert result["ok"], result["note"]


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(500, 500)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}


def vectors(seed=5):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((3, 16))
    rows = [(k, (centre[k % 3] + rng.standard_normal(16) * 0.06).tolist(), k % 2) for k in range(150)]
    rows += [(200 + k, rng.standard_normal(16).tolist(), k % 2) for k in range(150)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [1.0, None] + [0.0] * 14, 1), (403, [float("nan")] * 16, 1), (404, [1.0] * 16, None), (405, [], 1), (406, [1e30] * 16, 0), (407, [2e30] * 16, 0), (408, [1.0, 1.0], 0)]
    return rows


def vector_truth(rows, threshold=0.98):
    good = {i: (l, np.array(x, float) / np.linalg.norm(np.array(x, float) / np.abs(x).max()) / np.abs(x).max()) for i, x, l in rows
            if l is not None and x and None not in x and np.isfinite(x).all() and any(x)}
    union, links = Union([r[0] for r in rows]), {r[0]: 0 for r in rows}
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= threshold:
                links[a] += 1
                links[b] += 1
                union.join(a, b)
    return {i: (links[i], union.find(i)) for i in links}


@pytest.mark.parametrize("limit", [2048, 8])
def test_vector_links_match_all_pairs(spark, limit):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(frame, limit=limit).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in vector_truth(rows).items()}


def at_angle(degrees, jitter=0.0, rng=None):
    v = np.zeros(16)
    v[0], v[1] = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return (v + jitter * rng.standard_normal(16) if jitter else v).tolist()


def test_saturated_lists_hide_no_links(spark):
    """Exact and near copies fill every list; links between the groups, and along a chain of three, are still found."""
    rng = np.random.default_rng(5)
    apart = math.degrees(math.acos(0.985))
    rows = [(k, at_angle(0 if k < 20 else apart), 1) for k in range(40)]
    rows += [(100 + k, at_angle((k // 30) * apart, 1e-4, rng), 2) for k in range(90)]
    rows += [(300 + k, rng.standard_normal(16).tolist(), 2) for k in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(frame).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in vector_truth(rows).items()}
    assert got[0] == (39, 0, True) and got[100][1] == got[189][1] == 100


def test_one_vector_nine_thousand_times(spark):
    rows = spark.range(9_000).selectExpr("id AS vec_id", "array(1.0D, 2.0D, 3.0D) AS embedding", "1 AS label")
    found = nn_descent.near_duplicates(rows).groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in found] == [(8_999, 0, 9_000)]


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "recall", lambda *a: 0.5)
    with pytest.raises(RuntimeError, match="recall"):
        nn_descent.near_duplicates(spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<double>, label int"))


def test_vectors_with_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (None, [1.0, 0.01], 1), (None, None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert nn_descent.near_duplicates(frame).count() == 5
    assert nn_descent.near_duplicates(frame.limit(0)).collect() == []


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(k, prose(k, rng.randrange(0, 60)), "en", rng.choice(["a", "b", "c", "d", "é", None])) for k in range(300)] + [(900, None, "en", "zero"), (901, prose(5, 10), "en", "tiny"), (902, prose(6, 400), "en", "a")]
    docs = documents(spark, rows).repartition(3)
    got = mixing.mix(mixing.sized(docs).select("doc_id", "source", "size")).join(docs.select("doc_id", "source"), "doc_id").collect()
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in sources}
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    target = {s: total * weight[s] / sum(weight.values()) for s in sources}
    full = set()
    while over := {s for s in sources if target[s] > 3 * sizes[s] + 1e-9}:
        full |= over
        rest = total - sum(3 * sizes[s] for s in full)
        left = sum(weight[s] for s in sources if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / left for s in sources}
    for s, own in by_source(got).items():
        assert math.isclose(own[0].target, target[s], rel_tol=1e-9) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - target[s]) <= 1
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    again = mixing.balance(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mixing_rates_are_the_entropy_solution(spark):
    docs = documents(spark, [(k, prose(k, 10 + k), "en", "ab"[k % 2]) for k in range(40)])
    histogram = mixing.sized(docs).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    for r in mixing.dual(histogram, mixing.source_targets(totals)).collect():
        own = [(x.size, x.n) for x in histogram.collect() if x.source == r.source]
        assert math.isclose(sum(s * n * min(3, math.exp(r.t * s / r.mean)) for s, n in own), r.target, rel_tol=1e-4)


def test_copies_by_cutoffs_are_the_mix(spark):
    rng = random.Random(4)
    rows = [(k, prose(k, rng.randrange(0, 60)), "en", rng.choice(["a", "b", "c", "d", None])) for k in range(400)] + [(900, None, "en", "zero"), (901, prose(5, 10), "en", "tiny")]
    docs = documents(spark, rows).repartition(3)
    cuts = mixing.cutoffs(mixing.sized(docs))
    got = {r.doc_id: r.copies for r in mixing.with_copies(docs, cuts).collect()}
    want = {r.doc_id: math.floor(r.taken / r.size + 0.5) if r.size else 0 for r in mixing.balance(docs).collect()}
    assert got == want and len(set(want.values())) == 4
    again = mixing.with_copies(documents(spark, awkward()), mixing.cutoffs(mixing.sized(documents(spark, awkward()))))
    assert again.count() == len(awkward())
    nothing = documents(spark, [])
    assert mixing.with_copies(nothing, mixing.cutoffs(mixing.sized(nothing))).collect() == []


def test_a_dual_that_does_not_converge_is_an_error(spark):
    histogram = spark.createDataFrame([("a", 7, 3), ("a", 50, 2), ("b", 9, 40)], "source string, size long, n long")
    totals = spark.createDataFrame([("a", 121), ("b", 360)], "source string, source_size long")
    with pytest.raises(RuntimeError):
        mixing.dual(histogram, mixing.source_targets(totals), steps=1, tolerance=0.0)


def test_mixing_on_awkward_rows(spark):
    assert mixing.balance(documents(spark, awkward())).count() == len(awkward())
    assert mixing.balance(documents(spark, [])).collect() == []
    assert {r.taken for r in mixing.balance(documents(spark, [(1, None, None, None), (2, "", None, "a")])).collect()} == {0}


def test_shards_are_even_and_slots_have_no_gaps(spark):
    rows = [(k, "x" * (k % 97), "en", "a") for k in range(2000)]
    got = sharding.shard(documents(spark, rows).repartition(3)).collect()
    sizes, slots = {}, {}
    for r in got:
        assert r.size == len(rows[r.doc_id][1]) + 8
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 105
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(sharding.shard(documents(spark, awkward())).collect()) == len(awkward())
    assert sharding.shard(documents(spark, [])).collect() == []


def test_rebalancing_for_one_more_shard_moves_only_what_it_needs():
    loads = {slot: 10 + slot % 7 for slot in range(400)}
    before = sharding.rebalance(sharding.initial_map(400, 8), loads, 8)
    after = sharding.rebalance(before, loads, 9)
    total = [sum(b for s, b in loads.items() if after[s] == k) for k in range(9)]
    assert max(total) - min(total) <= 2
    assert sum(before[s] != after[s] for s in loads) <= 400 / 9 * 2


def test_a_stored_map_is_read_edited_and_appended(spark, tmp_path):
    path = str(tmp_path / "map")
    slim = sharding.slotted(documents(spark, [(k, prose(k, 10 + k % 30), "en", "s") for k in range(400)]), 256).cache()

    def versions():
        got = {}
        for r in spark.read.parquet(path).collect():
            got.setdefault(r.version, {})[r.vslot] = r.shard
        return got

    sharding.plan_map(slim, 8, 256, path)
    before = versions()
    assert set(before) == {1, 2} and before[1] == sharding.initial_map(256, 8)
    sharding.plan_map(slim, 9, 256, path)
    after = versions()
    assert set(after) == {1, 2, 3} and {v: after[v] for v in (1, 2)} == before
    loads = {r.vslot: r.bytes for r in sharding.slot_loads(slim).collect()}
    assert after[3] == sharding.rebalance(before[2], loads, 9)
    assert {after[3][k] for k in after[3] if after[3][k] != before[2][k]} <= set(range(9)) and sum(after[3][k] != before[2][k] for k in after[3]) < 100
    placed = sharding.place(slim, sharding.stored_map(spark, path))
    assert {r.shard for r in placed.collect()} == set(range(9))
    assert {r.shard for r in sharding.place(slim, sharding.stored_map(spark, path), 2).collect()} == set(range(8))
    with pytest.raises(ValueError, match="virtual slots"):
        sharding.plan_map(slim, 8, 128, path)
    assert versions() == after


def test_shards_equal_a_plain_version(spark):
    """Sizes, checksums and places from plain Python, for ids that repeat, are negative or null."""
    rows = [(k % 190 - 20, prose(k % 170, 5 + k % 40), "en", "s") for k in range(400)] + [(None, prose(k % 3, 8), "en", "s") for k in range(30)] + awkward()
    got = sharding.shard(documents(spark, rows).repartition(5), 7, 64).collect()
    plain = sorted((-1 if i is None else 0, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else 0, r.doc_id or 0, r.text_crc32, r.size) for r in got) == plain
    for s in range(7):
        own = sorted((r for r in got if r.shard == s), key=lambda r: (r.vslot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size))
        assert sorted(r.slot for r in own) == list(range(len(own)))
        keys = [(r.vslot, r.doc_id, r.text_crc32, r.size) for r in own]
        assert [(r.vslot, r.doc_id, r.text_crc32, r.size) for r in sorted(own, key=lambda r: r.slot)] == keys
    at = {}
    for r in got:
        assert at.setdefault(r.vslot, r.shard) == r.shard


def test_line_rules_on_awkward_rows(spark):
    got = line_rules.rules(documents(spark, awkward())).collect()
    assert len(got) == len(awkward())
    blank = [r for r in got if r.doc_id in (5, 6, 7)]
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in blank)
    repeated = next(r for r in got if r.doc_id == 14)
    assert repeated.n_repeat_words == 300 and repeated.base_failed
    assert line_rules.rules(documents(spark, [])).collect() == []


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    footer = "All rights of this page belong to the people of page 12"
    rows = [(k, prose(k, 40) + "\n" + footer.replace("12", str(10 + k)), "en", "h") for k in range(50)] + [(99, "\n".join([footer] * 4), "en", "h"), (100, footer + " alone and then more words than that", "en", "i")]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in line_rules.rules(docs).collect()}
    assert got[0].n_line_words == 12 and got[0].kept and not got[99].kept
    found = line_rules.frequent_lines(docs)
    assert found.count() == 1
    cleaned = {r.doc_id: r.text for r in line_rules.clean_text(docs, found).collect()}
    assert cleaned[3] == prose(3, 40) and cleaned[100] == rows[-1][1] and cleaned[99] == ""


def test_line_limit_is_absolute_on_large_hosts_and_counts_documents(spark):
    rare, often = "this line is in fewer documents than the limit", "this line stands in one of twenty documents here"
    rows = [(k, f"words of document number {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100 % 6]}{'ABCDEFGH'[k // 600]}" + (f"\n{often}" if k % 20 == 0 else "") + (f"\n{rare}" if k < 100 else ""), "en", "big") for k in range(2400)]
    rows += [(5000 + k, "a copied page of some length", "en", "big") for k in range(101)]
    docs = documents(spark, rows)
    found = {r.n_docs for r in line_rules.frequent_lines(docs).collect()}
    assert found == {120, 101}  # 5% of the host; copies count as documents
    twice = docs.unionByName(docs)  # repeated rows do not
    assert {r.n_docs for r in line_rules.frequent_lines(twice).collect()} == found
    assert {r.n_docs for r in line_rules.frequent_lines(docs, most=130).collect()} == set()


def secret_rows():
    rng = random.Random(8)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    rows = [(k, f"{prose(k, 12)} token = \"{h}\" and thereafter longestpossibleword{k % 3} goes", "en", "a") for k, h in enumerate(hexes)]
    return rows + [(100 + k, "antidisestablishmentarianism internationalisation " + prose(k, 10), "en", "a") for k in range(30)], hexes


def test_secrets_are_found_and_masked(spark):
    rows, hexes = secret_rows()
    docs = documents(spark, rows)
    found = secrets.scan(docs).filter("is_secret")
    assert {r.candidate for r in found.collect()} == set(hexes)
    masked = {r.doc_id: r.text for r in secrets.mask(docs, found).collect()}
    assert all(secrets.MASK in masked[k] and hexes[k] not in masked[k] for k in range(30))
    assert all(masked[r[0]] == r[1] for r in rows[30:])


def test_every_run_of_a_word_is_a_candidate(spark):
    rng = random.Random(9)
    hexed = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(4)]
    jwt = ["eyJhbGciOiJIUzI1NiJ9", "eyJzdWIiOiIxMjM0NTY3ODkwIn0", "dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"]
    aws, github = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "ghp_" + "a1B2" * 9
    texts = [f"AWS_SECRET_ACCESS_KEY={aws}", f"GITHUB_ACCESS_TOKEN={github}", f"DATABASE_MASTER_PASSWORD={hexed[0]}", f'{{"first_secret":"{hexed[1]}","other_api_key":"{hexed[2]}"}}',
             f"https://example.org/long/path/of/page?token={hexed[3]}", "Bearer " + ".".join(jwt), "password = 'ab12cd34'", "an ordinary word pa55word", "pass=" + hexed[0] + ":" + hexed[0]]
    docs = documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    found = secrets.candidates(docs).collect()
    assert all(r.word[r.offset:r.offset + len(r.candidate)] == r.candidate for r in found)
    listed = [(r.doc_id, r.candidate) for r in found]
    wanted = [(0, aws), (1, github), (2, hexed[0]), (3, hexed[1]), (3, hexed[2]), (4, hexed[3]), *((5, x) for x in jwt), (6, "ab12cd34"), (8, hexed[0])]
    assert set(wanted) <= set(listed) and listed.count((8, hexed[0])) == 2 and not [x for x in listed if x[0] == 7]
    secret = {(r.doc_id, r.candidate) for r in secrets.scan(docs).filter("is_secret").collect()}
    masked = {r.doc_id: r.text for r in secrets.mask(docs, secrets.scan(docs).filter("is_secret")).collect()}
    assert {(1, github), (2, hexed[0]), (3, hexed[1]), (3, hexed[2]), (4, hexed[3])} <= secret
    assert masked[3] == '{"first_secret":"[SECRET]","other_api_key":"[SECRET]"}' and hexed[3] not in masked[4]


def test_masks_stand_at_the_places_of_findings(spark):
    """The same run elsewhere in the text stays; ids that are null or repeat keep their own texts; white space stays."""
    a, b = "0123456789abcdef" * 2, "fedcba9876543210" * 2
    texts = [(1, f"  token={a},{b};x\n\nhttp://h/{a}more {a}\t"), (1, f"{b} at first, token={b}"), (None, f"token={a}"), (None, "nothing here"), (2, None), (3, "")]
    docs = documents(spark, [(i, t, "en", "s") for i, t in texts] + [(1, f"{b} at first, token={b}", "en", "s")])
    found = secrets.candidates(docs)
    chosen = found.filter(F.col("left").rlike("token=$") | (F.col("candidate") == b) & (F.col("place") == 0) & F.col("word").rlike("^token"))
    got = sorted((r.doc_id or 0, r.text or "") for r in secrets.mask(docs, chosen).collect())
    m = secrets.MASK
    assert got == sorted([(1, f"  token={m},{m};x\n\nhttp://h/{a}more {a}\t"), (1, f"{b} at first, token={m}"), (1, f"{b} at first, token={m}"),
                          (0, f"token={m}"), (0, "nothing here"), (2, ""), (3, "")])
    assert secrets.mask(docs, chosen).columns == docs.columns and secrets.mask(docs, chosen.limit(0)).count() == 7


def test_secret_forest_learns_from_given_findings(spark):
    rows, _ = secret_rows()
    docs = documents(spark, rows)
    found = secrets.candidates(docs)
    features = secrets.featured(found, secrets.pair_dictionary(found))
    reviewed = features.withColumn("rule_label", (~F.col("candidate").rlike("^[0-9a-f]+$")).cast("double"))
    assert not secrets.scan(docs, reviewed).filter("is_secret").filter(F.col("candidate").rlike("^[0-9a-f]{40}$")).count()


def test_secrets_on_awkward_rows(spark):
    docs = documents(spark, [*awkward(), (None, "password=0123456789abcdef0123", None, None)])
    found = secrets.scan(docs)
    assert [r.candidate for r in found.filter("is_secret").collect()] == ["0123456789abcdef0123"]
    assert secrets.mask(docs, found.filter("is_secret")).count() == len(awkward()) + 1
    assert secrets.scan(documents(spark, [])).collect() == []


def test_quality_of_held_out_labels(spark):
    docs = spark.read.parquet(f"/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/sf0.01/labels.parquet")
    train = labels.filter("doc_id % 2 = 0")
    model = quality.fit(docs, train)
    assert [h["round"] for h in model.history] == list(range(5)) and model.history[-1]["meta_labels"] > 0
    rows = quality.score(docs.join(labels.filter("doc_id % 2 = 1"), "doc_id"), model).collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_all_unlabelled_rows_take_part_and_reruns_agree(spark):
    rng = np.random.default_rng(3)
    truth = rng.random(9_000) < 0.7
    content = (rng.standard_normal((9_000, 6)) + truth[:, None] * 2).astype(np.float16)
    meta = (rng.standard_normal((9_000, 4)) + truth[:, None] * 1.5).astype(np.float16)
    meta[8_000:, 3] += 5
    pool = spark.createDataFrame([(c.tobytes(), m.tobytes()) for c, m in zip(content[300:], meta[300:], strict=True)], "content binary, meta binary")
    y = truth[:300].astype(float)

    def weights(rows):
        model = quality.co_train(content[:300], meta[:300], y, rows)
        return np.concatenate([model.content.weights, model.meta.weights, model.combine]), model

    a, model = weights(pool.repartition(7))
    b, _ = weights(pool.coalesce(1))
    assert np.abs(a - b).max() < 1e-5
    assert np.abs(a - weights(pool.limit(6_000))[0]).max() > 1e-3
    assert [h["round"] for h in model.history] == list(range(5)) and model.history[1]["meta_labels"] > 500
    margin = model.content.margin(content.astype(float))
    assert ((margin > 0) == truth).mean() > 0.95
    sums = quality.add_up(pool.repartition(40), lambda x: np.concatenate([model.content.sums(x[0], np.ones(len(x[0]))), quality.moments_of(x[1])]), 56 + 9)
    plain = np.concatenate([model.content.sums(content[300:].astype(float), np.ones(8_700)), quality.moments_of(meta[300:].astype(float))])
    assert np.allclose(sums, plain)
    assert (quality.add_up(pool.filter("content IS NULL"), lambda x: np.ones(3), 3) == 0).all()


def test_sums_over_vectors_widen_few_rows_at_once(spark):
    one = spark.range(0, 5000, 1, 1).select(F.expr(f"cast(repeat('a', {2 * quality.CONTENT}) as binary)").alias("content"), F.expr(f"cast(repeat('a', {2 * quality.META}) as binary)").alias("meta"))
    for pool in (one, one.repartition(40), one.limit(0)):
        rows, wide = quality.add_up(pool, lambda x: np.array([len(x[0]), len(x[0]) > 1000]), 2)
        assert (rows, wide) == (pool.count(), 0)


def test_dealt_records_come_in_small_batches():
    from skyledger.llm import fragments as fr

    x = np.arange(1 << 19, dtype=np.uint64)
    batches = list(fr.gathered(iter([{"x": x}]), {"x": "u8"}, lambda c: (c["x"] % 64).astype(np.int32)))
    assert max(b.nbytes for b in batches) <= 2 << 20
    assert sorted(np.concatenate([fr.unpack(raw, "u8") for b in batches for raw in b.column("x").to_pylist()]).tolist()) == x.tolist()


def test_cuts_take_the_surest_rows():
    margin = np.array([-9.0, -3, 0, 1, 2.3, 2.5, 2.5, 4, 6, 40])
    counts = np.bincount(quality.margin_bins(margin), minlength=3501)
    taken = {wanted: [m for m in margin if m >= quality.cut_of(counts, wanted, math.log(9))[0]] for wanted in (0, 2, 4, 5, 99)}
    assert taken == {0: [40], 2: [6, 40], 4: [4, 6, 40], 5: [2.5, 2.5, 4, 6, 40], 99: [2.3, 2.5, 2.5, 4, 6, 40]}
    assert all(quality.cut_of(counts, w, math.log(9))[1] == len(t) for w, t in taken.items())


def test_scores_replace_columns_of_their_names_and_repeated_ids_train_alike(spark):
    rows = [(k % 60, prose(k, 40) if k % 3 else " ".join(w + "##" for w in prose(k, 30).split()), "en", "s") for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(40)], "doc_id long, quality int")
    docs = documents(spark, rows).withColumn("score", F.lit("x")).withColumn("kept", F.lit("y"))
    first = quality.classify(docs.repartition(5), labels)
    assert first.schema["score"].dataType.simpleString() == "double" and first.columns.count("kept") == 1
    again = quality.classify(docs.repartition(3), labels)
    assert sorted((r.doc_id, r.text, round(r.score, 4)) for r in first.collect()) == sorted((r.doc_id, r.text, round(r.score, 4)) for r in again.collect())


def test_quality_on_awkward_rows(spark):
    docs = documents(spark, awkward())
    one_class = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, one_class), prefix="q_").select(F.col("q_score").alias("score")).collect()} == {1.0}
    two = spark.createDataFrame([(1, 1), (11, 1), (13, 1), (14, 0), (8, 0), (6, 0), (7, 0), (14, 1)], "doc_id long, quality int")
    scored = quality.score(docs, quality.fit(docs, two), prefix="q_").collect()
    assert len(scored) == len(awkward()) and all(0 <= r.q_score <= 1 for r in scored)
    assert quality.score(documents(spark, []), quality.fit(docs, two), prefix="q_").collect() == []


def test_pipeline_stages_take_effect(spark, tmp_path):
    junk = [(k, " ".join(w + "###" for w in prose(k, 40).split()), "en", "s") for k in range(200, 260)]
    clean = [(k, prose(k, 60), "en", "st"[k % 2]) for k in range(100)]
    near = [(100 + k, prose(k, 60) + " more", "en", "t") for k in range(10)]
    rows, hexes = secret_rows()
    leaky = [(300 + k, prose(1000 + k, 40) + f" token = \"{h}\" done", "en", "u") for k, h in enumerate(hexes)]
    all_rows = clean + near + junk + leaky
    docs = documents(spark, all_rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0 if i >= 200 and i < 260 else 1) for i, *_ in all_rows if i % 3], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = seen[name] = spark.read.parquet(str(tmp_path / name))
    ids = {name: [r.doc_id for r in frame.select("doc_id").collect()] for name, frame in seen.items()}
    assert not set(ids["quality_classifier"]) & set(range(200, 260)) and len(ids["quality_classifier"]) >= 0.95 * (len(all_rows) - 60)
    assert set(ids["quality_classifier"]) - set(ids["ngram_jaccard_join"]) == set(range(100, 110)) & set(ids["quality_classifier"])
    assert sorted(ids["secret_scans"]) == sorted(ids["ngram_jaccard_join"])
    assert not seen["secret_scans"].filter(F.col("text").rlike("token = \"[0-9a-f]{40}")).count()
    assert all(seen[name].columns == docs.columns for name, _ in corpus_pipeline.STAGES[:-1])
    words = seen["source_mixing"].withColumn("w", mixing.n_words(F.col("text"))).groupBy("source").agg(F.sum("w").alias("w"))
    assert words.count() >= 2 and max(ids["source_mixing"].count(i) for i in set(ids["source_mixing"])) <= 3
    assert sorted(ids["bpe_encoding"]) == sorted(ids["source_mixing"])


def test_pipeline_stages_on_awkward_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, rows in enumerate((awkward(), [])):
        now = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", "score")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"{k}-{name}"))
            now = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
