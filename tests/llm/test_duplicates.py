import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from strataflow.llm import jaccard_join, quality_rules, suffix_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(texts):
    out = []
    for x in texts:
        w = WORD.findall((x or "").translate(LOW))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute_groups(texts):
    s = sets(texts)
    parent, links = list(range(len(s))), [0] * len(s)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, x in enumerate(s):
        for j in range(i):
            both = len(x & s[j])
            if both and 100 * both >= 80 * (len(x) + len(s[j]) - both):
                parent[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    return [find(i) for i in range(len(s))], links, [len(x) for x in s]


@pytest.mark.parametrize("tile,hot", [(1024, 64), (3, 2)])
def test_join_against_brute_force(monkeypatch, docs, rows, tile, hot):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    group, links, size = brute_groups([r[1] for r in rows])
    least = defaultdict(list)
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g].append(r[0])
    want = sorted((str(r[0]), n, min(least[g], default=None), k) for r, g, k, n in zip(rows, group, links, size))
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.join_documents(docs).collect())
    assert got == want and sum(k > 0 for k in links) > 20


def test_join_of_sizes_that_cannot_link_ships_no_digest(spark):
    """Digests of many documents share n-grams with all of them, but meet none of them in a block."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shipped = []
    for n in (20, 40):
        parts = [" ".join(word() for _ in range(rng.randint(20, 60))) for _ in range(n)]
        texts = [*parts, " ".join(parts), " ".join([*parts, "tail"]), *(p + " changed" for p in parts[: n // 2])]
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        sets = jaccard_join.document_sets(docs, 5, 80).where("grams is not null").dropDuplicates(["node"])
        prefix = sets.select("node", "n", "u", "grams").mapInArrow(jaccard_join._prefixes(80), "gram long, node long, n int")
        stars = jaccard_join._stars(prefix, 80).join(sets.select("node", "n"), "node")
        shipped.append(stars.agg({"n": "sum"}).first()[0])
        group, links, _ = brute_groups(texts)
        got = {r.doc_id: (r.n_links, r.component_id) for r in jaccard_join.join_documents(docs).collect()}
        least = {g: min(i for i, h in enumerate(group) if h == g) for g in group}
        assert got == {i: (k, least[g]) for i, (g, k) in enumerate(zip(group, links))} and links[n] == 1
    assert shipped[1] < 3 * shipped[0]


def test_join_over_many_fragments(spark, docs, rows, monkeypatch):
    want = sorted(map(str, jaccard_join.join_documents(docs).drop("group").collect()))
    monkeypatch.setattr(jaccard_join, "tasks_for", lambda df: 9)
    monkeypatch.setattr(jaccard_join, "fragment_count", lambda tasks: 1 << 18)
    assert sorted(map(str, jaccard_join.join_documents(docs).drop("group").collect())) == want


def test_join_of_nothing(empty):
    assert jaccard_join.join_documents(empty).count() == 0


@pytest.mark.parametrize("hot,tasks", [(20_000, 4), (3, 4), (1, 9)])
def test_repeated_bytes_against_brute_force(monkeypatch, docs, rows, hot, tasks):
    monkeypatch.setattr(suffix_dedup, "HOT_GROUP", hot)
    monkeypatch.setattr(suffix_dedup, "tasks_for", lambda df: tasks)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if hot == 1 else "2000")
    raw = [(r[1] or "").encode() for r in rows]
    count = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    want = []
    for r, b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want.append((str(r[0]), len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(x for x, g in zip(b, gone) if not g)))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.removed_spans(docs).collect())
    assert got == sorted(want) and sum(w[2] > 0 for w in want) > 10


def test_dedup_returns_the_documents(docs, empty):
    got = suffix_dedup.dedup_documents(docs)
    assert got.schema == docs.schema and got.count() == docs.count() and got.where("text is null").count() == 1
    others = lambda df: sorted(str([v for k, v in r.asDict().items() if k != "text"]) for r in df.collect())
    assert others(got) == others(docs)
    assert suffix_dedup.removed_spans(empty).count() == 0


def test_pipeline_stages(spark, docs, rows, empty):
    kept = corpus_pipeline.quality(spark, docs, "")
    assert kept.count() == quality_rules.score_documents(docs).where("kept").count()
    group, links, _ = brute_groups([r[1] for r in rows])
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    groups = defaultdict(list)
    for r, g, k in zip(rows, group, links):
        if k:
            groups[g].append(r)
    want = Counter((r[0], r[1]) for r, k in zip(rows, links) if not k)
    left = Counter({k: n - want[k] for k, n in got.items() if n > want[k]})
    assert not want - got and sum(left.values()) == len(groups)
    for members in groups.values():
        ids = [r[0] for r in members if r[0] is not None]
        assert any(key[0] == min(ids) and any(key == (r[0], r[1]) for r in members) for key in left)
    assert corpus_pipeline.near_duplicates(spark, empty, "").count() == 0
    cut = corpus_pipeline.repeated_passages(spark, docs, "")
    assert cut.columns == docs.columns and corpus_pipeline.near_duplicates(spark, docs, "").columns == docs.columns
    assert cut.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.pack(spark, docs, "")
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_stages_on_nothing_and_on_odd_rows(spark, empty):
    data, ddl = "/root/testdata/sf0.001", "doc_id long, text string, n_chars long, `a.b` string"
    odd = spark.createDataFrame([(None, None, None, "x"), (1, "", 0, "x"), (1, "", 0, "x"), (2, " \n", 2, None)], ddl)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0, name
        got = stage(spark, odd, data)
        assert got.count() == {"quality_rules": 0}.get(name, 4), name
        assert name == "best_fit_packing" or got.columns == odd.columns


def test_parts_are_dealt_evenly(spark):
    from pyspark.sql import functions as F

    from strataflow.llm import shared

    for count, tasks in ((125, 61), (5, 7), (64, 4), (3000, 1000), (1, 1)):
        ids = shared.even_parts(count, tasks)
        assert len(set(ids.tolist())) == count and (ids[1:] > ids[:-1]).all()
        rows = spark.createDataFrame([(int(i),) for i in ids], "part long").select(F.pmod(F.hash("part"), F.lit(tasks)).alias("p")).groupBy("p").count().collect()
        assert max(r[1] for r in rows) == -(-count // tasks) and len(rows) == min(count, tasks)
        assert {r[0] for r in rows} == set(shared._hash_place(ids, tasks).tolist())
