"""The training-data operators on small tables with nulls, ties, repeats and empty tables, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.llm import chosen_path, gif, language_id, line_dedup, mixing, nearest, packing, pii, url_filters, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, target int, node int, id int, w int"


def docs(spark, rows):
    """Rows (doc_id, text[, source[, lang]]) with other columns whose names clash with the operators' own."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", 2, 3, 4, 5) for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (4, "a b c"), (None, "a b c"), (5, "x" * 50_000), (6, "\n\n")]


# ---- 1 mixing

def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_sainte_lague_against_one_seat_at_a_time():
    rng = random.Random(3)
    for _ in range(60):
        votes = np.array([rng.choice([0, 1, 5, 5, 17, 100, 1000 * rng.random()]) for _ in range(rng.randrange(1, 9))])
        caps = np.array([rng.choice([0, 3, 1000]) for _ in votes])
        seats = rng.randrange(0, 60)
        want = np.zeros(len(votes), int)
        for _ in range(seats):
            q = [v / (2 * k + 1) if v > 0 and k < c else -1 for v, k, c in zip(votes, want, caps, strict=True)]
            if max(q) <= 0:
                break
            want[int(np.argmax(q))] += 1
        assert mixing.sainte_lague(votes, seats, caps).tolist() == want.tolist(), (votes, caps, seats)


def test_targets():
    assert mixing.targets(np.array([100, 100, 100]), np.array([5, 2, 1])).tolist() == pytest.approx([200, 166.6666667, 83.3333333])
    assert mixing.targets(np.array([10, 1000]), np.array([5, 2])).sum() == pytest.approx(1515)
    assert mixing.targets(np.array([0, 0]), np.array([5, 2])).tolist() == [0, 0]


def test_mix_takes_near_targets_and_never_too_much(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 300])), rng.choice(["a", "b", "b", "b", "é", None])) for i in range(400)]
    df = docs(spark, rows)
    got = mixing.mix_sources(df).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], words(r[1])) for r in rows)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {n: sum(words(r[1]) for r in rows if r[2] == n) for n in names}
    goal = dict(zip(names, mixing.targets(np.array([size[n] for n in names]), np.resize([5.0, 2, 1], len(names))), strict=True))
    for n in names:
        own = [r for r in got if r["source"] == n]
        assert {r["source_size"] for r in own} == {size[n]} and own[0]["target"] == pytest.approx(goal[n])
        assert sum(r["taken"] for r in own) == pytest.approx(goal[n], rel=0.01)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(df.repartition(7)).collect()), key=str)
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    taken = defaultdict(int)
    for r in mixed.collect():
        taken[r["doc_id"]] += words(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert dict(taken) == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


def test_mix_of_odd_rows(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    got = mixing.mix_sources(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and sum(r["size"] for r in got) == 10
    assert mixing.mix_sources(docs(spark, [(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0
    assert mixing.mixed_rows(docs(spark, [])).count() == 0


def test_quotas_of_many_sources_are_those_of_few(spark):
    rng = random.Random(5)
    rows = [(f"s{i}", rng.choice([0, 3, 700, 700, 90_000]), rng.randrange(1, 9)) for i in range(200)] + [(None, 512, 3), ("", 1000, 1), ("é", 600, 2)]
    stats = spark.createDataFrame(rows, "source string, source_size long, n_docs long").repartition(5)
    want = mixing.source_quotas(stats.toPandas()).astype({"source": object})
    got = {r["source"]: r for r in mixing.quotas_of_many(stats).collect()}
    assert len(got) == len(want)
    for r in want.itertuples():
        name = None if isinstance(r.source, float) else r.source
        assert (got[name]["seats"], got[name]["block"], got[name]["shards"]) == (r.seats, r.block, r.shards) and got[name]["target"] == pytest.approx(r.target)


def test_mix_with_many_sources(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (i % 40)), f"s{i % 30}" if i % 7 else None) for i in range(600)]
    few = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs(spark, rows)).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 5)
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs(spark, rows)).collect()} == few


def test_mixed_rows_with_odd_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", "s", "x", "y"), (1, "a b c d", "s", "x", "z"), (None, "e f", None, None, "z"), (2, None, "s", None, "q")], "doc_id long, text string, source string, n_chars string, shard string")
    got = mixing.mixed_rows(df).collect()
    assert got and all(r["n_chars"] == str(len(r["text"])) for r in got) and {r["doc_id"] for r in got} <= {1, None}


# ---- 2 line dedup

def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    where = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                where[key(x)].add(-math.inf if i is None else i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(where.get(key(x), ())) >= min_docs and (-math.inf if i is None else i) < max(where[key(x)]))]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_against_brute_force(spark):
    rng = random.Random(7)
    pool = ["  Long line number %d %s\r" % (i, "ÄB" * 20) for i in range(6)] + ["short", "", "é" * 39, "é" * 40, "E" + "é" * 39]
    rows = [(rng.choice([None, *range(40)]), "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for _ in range(60)] + [(50, None), (51, "")]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_lines(rows)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_runs_are_compacted_by_levels(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        batch = spark.createDataFrame([(9 - k, b"all"), (9 - k, b"k%d" % k)], "id long, hash binary")
        assert runs.new_lines(batch).count() == (2 if k == 0 else 1)
        runs.add(batch)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {bytes(r["hash"]): (r["n_docs"], r["last_id"]) for r in runs.seen().collect()} == {b"all": (5, 9)} | {b"k%d" % k: (1, 9 - k) for k in range(5)}


# ---- 3 n-gram Jaccard join

def shingle_set(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(rows):
    sets = [shingle_set(t) for _, t in rows]
    n, root = len(rows), list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 5 * k >= 4 * (len(sets[i]) + len(sets[j]) - k):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    ids = defaultdict(list)
    for i in range(n):
        ids[top(i)].append(rows[i][0])
    low = lambda x: -math.inf if x is None else x
    return sorted(((rows[i][0], min(ids[top(i)], key=low), links[i]) for i in range(n)), key=str)


def near_rows():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(12):
        base = rng.choices(vocab, k=rng.choice([3, 8, 60, 200]))
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((i, " ".join(t)))
            i += 1
    return rows


def test_join_against_brute_force(spark):
    rows = near_rows() + ODD + [(90, "A  B\nC")]
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.classify(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_links(rows)
    assert chosen_path.classify(docs(spark, [])).count() == 0


def test_join_with_split_buckets_and_cells(spark, monkeypatch):
    """Tiny limits: buckets are split, dense ones compared in cells, components checked in cells."""
    monkeypatch.setattr(chosen_path, "CELL_SETS", 3)
    real = chosen_path.buckets
    monkeypatch.setattr(chosen_path, "buckets", lambda nodes, runs, equal: real(nodes, runs, equal, 4))
    rng = random.Random(2)
    base = [f"v{i}" for i in range(150)]
    rows = near_rows() + [(1000 + k, " ".join(base[:j] + [f"x{k}"] + base[j + 1 :])) for k, j in enumerate(rng.choices(range(150), k=30))]
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.classify(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_links(rows)


def test_a_large_class_takes_few_rows(spark, monkeypatch):
    """k near copies of one text: rows in buckets, edges and blocks grow with k, and links are those of brute force."""
    rng = random.Random(12)
    base = [f"v{i}" for i in range(150)]
    rows = [(k, " ".join(base[:j] + [f"x{k}"] + base[j + 1 :])) for k, j in enumerate(rng.choices(range(150), k=420))]
    monkeypatch.setattr(chosen_path, "CELL_SETS", 60)
    real, size = chosen_path.buckets, []

    def counted(nodes, runs, equal):
        cells, edges = real(nodes, runs, equal, 50)
        size.append((cells.count(), edges.count()))
        return cells, edges

    monkeypatch.setattr(chosen_path, "buckets", counted)
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.classify(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_links(rows)
    runs = chosen_path.runs_for(chosen_path.RECALL, chosen_path.THRESHOLD)
    assert size[0][0] < 2 * runs * 420 and size[0][1] < 3 * chosen_path.CHIEFS * runs * 420, size


def test_one_of_each_class_stays(spark):
    rows = near_rows() + [(None if i is None else i + 500, t) for i, t in ODD]
    kept = chosen_path.first_of_each_class(docs(spark, rows))
    want = {c for _, c, _ in brute_links(rows)}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(want, key=str)


def test_one_of_each_class_stays_of_rows_that_share_an_id(spark):
    rng = random.Random(8)
    base = [[f"k{k}x{i}" for i in range(80)] for k in range(3)]
    near = lambda k, i: " ".join([*base[k][:i], "other", *base[k][i + 1 :]])
    full = lambda k: " ".join(base[k])
    rows = [(None, full(0)), (None, near(0, 0)), (None, near(0, 79)), (None, None), (None, None), (None, ""), (3, full(1)), (7, near(1, 0)), (7, full(2)), (7, near(2, 0)), (9, near(2, 79)), (9, full(2) + "  ")]
    rng.shuffle(rows)
    kept = [(r["doc_id"], r["text"]) for r in chosen_path.first_of_each_class(docs(spark, rows)).collect()]
    with_words = [(i, next(k for k in range(3) if f"k{k}x5" in t)) for i, t in kept if t]
    assert sorted(with_words, key=str) == [(3, 1), (7, 2), (None, 0)]
    assert sorted((x for x in kept if not x[1]), key=str) == [(None, ""), (None, None)]


def test_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 50, n).astype(np.uint64)) for n in (3, 30, 1, 20, 40)]
    assert chosen_path.intersections(sets, columns=7).astype(int).tolist() == [[len(np.intersect1d(a, b)) if a is not b else int(np.isin(a, np.concatenate([s for s in sets if s is not a])).sum()) for b in sets] for a in sets]
    assert chosen_path.intersections(sets[:2], sets[2:], columns=7).astype(int).tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:2]]


# ---- 4 URL filters

def test_stated_rules_and_parts(spark):
    urls = ["https://a.EXAMPLE.com/en/7?x", "http://b.com/en/", "http://com/en/1", "http://xcom/en/1", "ftp://q.net/de/8", "http://w.example.net/de/8#f", "no scheme", None, "x://h?a://b/en/", "http://h.org", "http://h.org/es/\nq"]
    pages = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, none).collect()}
    assert got == {
        0: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 1: ("b.com", "/en/", "com/en/", "block"), 2: ("com", "/en/1", "com/en/", "block"), 3: ("xcom", "/en/1", None, "allow"), 4: ("q.net", "/de/8", "net/de/", "block"),
        5: ("w.example.net", "/de/8", "example.net/de/8", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("h", "", None, "allow"), 9: ("h.org", "", None, "allow"), 10: ("h.org", "/es/\nq", "org/es/", "block"),
    }
    assert url_filters.judge(pages.where("false"), none).count() == 0


def test_rules_are_mined_from_labels(spark):
    lab = [("http://casino.x/p", True)] * 8 + [("http://shop.x/p", False)] * 20 + [("http://shop.x/win", True)] * 6 + [("http://blog.x/win", False)] * 20 + [(None, True), ("http://q.x/", None)]
    labelled = spark.createDataFrame(lab, "url string, bad boolean")
    rules = {tuple(r["antecedent"]) for r in url_filters.mine(labelled, support=0.05, confidence=0.6).collect()}
    assert rules == {("casino",), ("shop", "win")}
    pages = spark.createDataFrame([(1, "http://m.casino.y/"), (2, "http://shop.z/q/win"), (3, "http://shop.z/"), (4, "http://win.z/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, labelled, support=0.05, confidence=0.6).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_rules_of_any_length_against_brute_force(spark):
    from itertools import combinations

    rng = random.Random(6)
    rows = [("http://x/" + "/".join(sorted(rng.sample("abcdef", rng.randrange(1, 6)))), False) for _ in range(120)]
    rows = [(u, {"a", "b", "c"} < set(u[9:].split("/")) or rng.random() < 0.15) for u, _ in rows] + [("http://x/a/b/c", True)] * 4
    sets = [({"x", *u[9:].split("/")}, bad) for u, bad in rows]
    want = []
    for k in range(1, 8):
        for some in map(set, combinations("abcdefx", k)):
            marks = [bad for s, bad in sets if some <= s]
            if sum(marks) >= 4 and sum(marks) / len(marks) >= 0.75 and not any(w < some for w in want):
                want.append(some)
    assert any(len(w) > 2 for w in want)
    df = spark.createDataFrame(rows, "url string, bad boolean")
    got = [set(r["antecedent"]) for r in url_filters.mine(df, support=4 / len(rows), confidence=0.75).collect()]
    assert sorted(map(sorted, got)) == sorted(map(sorted, want))
    verdicts = {r["url"]: r["verdict"] for r in url_filters.judge(df.select("url"), df, support=4 / len(rows), confidence=0.75).collect()}
    assert verdicts == {u: "block" if any(w <= s for w in want) else "allow" for (u, _), (s, _) in zip(rows, sets, strict=True)}


def test_query_of_any_length_blocks_what_only_longer_rules_fit(spark, tmp_path):
    from strataforge.llm import queries
    from tests.compare import duck, rows

    urls = [("http://x/a/b/c", 1)] * 4 + [(f"http://x/{two}", 0) for two in ("a/b", "a/c", "b/c")] * 10 + [("http://x/a/b/d/e", None), (None, 1), ("http://y/e/c/f/b/a", None), ("http://y/a/b", None), ("http://z.com/en/a/b/c", 0)]
    spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, toxic) for i, (_, toxic) in enumerate(urls)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    blocked = {}
    for name in ("op4_url_filters", "op4_url_filters_any_length"):
        df = queries.queries()[name](spark, str(tmp_path))
        got = df.collect()
        blocked[name] = {r["page_id"] for r in got if r["verdict"] == "block"}
        want = duck(str(tmp_path)).sql(queries.oracle_sql()[name])
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    assert blocked == {"op4_url_filters": {38}, "op4_url_filters_any_length": {0, 1, 2, 3, 36, 38}}


def test_copies_of_a_long_url_do_not_multiply_sets(spark):
    """Tokens of the same baskets are mined as one: 2^40 sets otherwise; each of them still stands in rules of its own."""
    long = "/".join(f"t{i}x" for i in range(40))
    rows = [(f"http://h/{long}/v", True)] * 6 + [(f"http://h/{long}", False)] * 30 + [("http://h/v/u", False)] * 30 + [("http://h/u", False)] * 5
    df = spark.createDataFrame(rows, "url string, bad boolean")
    rules = sorted(r["antecedent"] for r in url_filters.mine(df, support=0.05, confidence=0.5).collect())
    assert rules == sorted(sorted([f"t{i}x", "v"]) for i in range(40))
    pages = spark.createDataFrame([(1, "http://q/t7x/v"), (2, "http://q/t7x/t8x"), (3, f"http://h/{long}"), (4, f"http://h/{long}/v")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge(pages, df, support=0.05, confidence=0.5).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "block"}


# ---- 5 language

def test_language_backoff_and_unknown(spark):
    rows = [(i, "der hund und die katze laufen schnell", "s", "de") for i in range(40)] + [(i, "the dog and the cat run quickly", "s", "en") for i in range(40, 80)]
    df = docs(spark, [*rows, (100, None), (101, " 12 !?"), (102, "the dogs", "s", None), (103, "der hunde", "s", None), (104, "ΩΩ", "s", None), (None, "the cat", "s", "en")])
    got = {r["doc_id"]: r for r in language_id.identify(df).collect()}
    assert (got[100]["lang_pred"], got[101]["lang_pred"]) == ("und", "und") and got[100]["score"] == 0
    assert (got[102]["lang_pred"], got[103]["lang_pred"]) == ("en", "de") and got[104]["lang_pred"] in ("de", "en")
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(80))
    assert got[None]["held_out"] is False and all(0 <= r["score"] <= 1 for r in got.values())
    model = language_id.fit(df)
    assert "dogs" not in model.rows[0] and model.predict("dogs")[0] == "en"
    assert language_id.identify(df.where("false")).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_language(train, texts):
    """Dense counts and plain loops: the model of all training rows, and each text's language and share."""
    langs = sorted({lang for _, lang in train})
    counts = [defaultdict(Counter) for _ in range(6)]
    for t, lang in train:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            counts[0][lang][w] += 1
            for n in range(1, 6):
                p = f" {w} "
                for i in range(len(p) - n + 1):
                    counts[6 - n][lang][p[i : i + n]] += 1
    items = [{x for lang in langs for x, c in k[lang].items() if c >= 2} for k in counts]
    get = lambda k, lang, x: c if (c := counts[k][lang][x]) >= 2 else 0
    total = [{lang: sum(get(k, lang, x) + 0.5 for x in items[k]) for lang in langs} for k in range(6)]
    logp = lambda k, lang, x: math.log((get(k, lang, x) + 0.5) / total[k][lang])

    def word(w, lang):
        if w in items[0]:
            return logp(0, lang, w)
        p = f" {w} "
        for n in range(5, 0, -1):
            found = [g for i in range(len(p) - n + 1) if (g := p[i : i + n]) in items[6 - n]]
            if found:
                return sum(logp(6 - n, lang, g) for g in found) / len(found)
        return 0.0

    out = []
    for t in texts:
        w = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not any(c.isalpha() for x in w for c in x):
            out.append(("und", 0.0))
            continue
        mean = [sum(word(x, lang) for x in w) / len(w) for lang in langs]
        out.append((langs[int(np.argmax(mean))], 1 / sum(math.exp(m - max(mean)) for m in mean)))
    return out


def test_language_by_brute_force(spark):
    rng = random.Random(21)
    stems = {"de": ["schön", "straße", "und", "Über", "katze"], "fr": ["été", "où", "le", "garçon", "œuvre"], "el": ["λόγος", "και", "ΣΟΦΟΣ"], "tr": ["İyi", "ılık", "ve"]}
    rows, i = [], 0
    for lang, own in stems.items():
        for _ in range(60):
            rows.append((i, " ".join(rng.choice(own) + rng.choice(["", "en", "s", "x1", "_y", "²"]) for _ in range(rng.randrange(1, 12))), "s", lang))
            i += 1
    more = ["", None, "12 _", "² ½", "nie gesehen", "Ωμέγα", "中文 字", "été-schön;und", "ÀÉÞ ß×÷ÿ", "ª º µ", "q" * 3000, "İSTANBUL ve", " ".join(["und", "le"] * 2000)]
    texts = [(1000 + k, t, "s", None) for k, t in enumerate(more)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs(spark, rows + texts)).collect()}
    train = [(t, lang) for j, t, _, lang in rows if zlib.crc32(str(j).encode()) % 4 != 2]
    for (j, t, *_), (lang, score) in zip(rows + texts, brute_language(train, [r[1] for r in rows + texts]), strict=True):
        assert got[j][0] == lang and got[j][1] == pytest.approx(score, abs=1e-9), (j, t)


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = language_id.op5_language_id(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.97 * n > 100


def test_no_language_is_left_out(spark):
    code = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    rows = [(4 * k + j, f"{code(k)}q {code(k)}q", "s", f"l{k:03}") for k in range(600) for j in range(4)]
    model = language_id.fit(docs(spark, rows))
    assert len(model.langs) >= 595 and model.predict(f"{code(577)}q")[0] == "l577"


def test_more_languages_than_the_default(spark):
    code = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    rows = [(4 * k + j, f"{code(k)}q {code(k)}q", "s", f"l{k:03}") for k in range(515) for j in range(4)]
    df = docs(spark, rows)
    assert len(language_id.fit(df, most_langs=600).langs) == 515 and len(language_id.fit(df, most_langs=2).langs) == 2


# ---- 6 nearest neighbours

def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((12, 24))
    x = centre[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 24))
    x[700:760] = x[700]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 24), (2100, [float("nan")] + [1.0] * 23), (2150, [None] + [1.0] * 23), (2200, [1.0]), (2250, [float("inf")] * 24)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = defaultdict(dict)
    for r in got:
        by[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    assert sorted(by) == list(range(0, 1500, 50))
    for q, found in by.items():
        s = u @ u[q]
        s[q] = -2
        best = np.lexsort((np.arange(len(s)), -s.round(12)))[:5]
        assert sorted(found) == [1, 2, 3, 4, 5] and all(abs(s[v] - sc) < 1e-12 for v, sc in found.values())
        hits += len(set(best) & {v for v, _ in found.values()})
    assert hits >= 0.9 * 5 * len(by)
    assert [by[700][k][0] for k in range(1, 6)] == [701, 702, 703, 704, 705]


def test_few_vectors(spark):
    df = lambda rows: nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert df([]) == [] and df([(0, [1.0, 0.0])]) == []
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in df([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0])])] == [(0, 1, 2), (0, 2, 1)]


def test_large_and_small_numbers(spark):
    """Vectors whose squares overflow or vanish have the cosines of their directions."""
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1e300, 0.0]), (3, [0.0, -5e-324])]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r["vec_id"], round(r["score"], 12)) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1.0), (2, round(0.5**0.5, 12)), (3, -round(0.5**0.5, 12))]


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0], 9, 1), (0, [0.0, 1.0], 9, 1), (7, [1.0, 0.1], 9, 1), (7, [0.1, 1.0], 9, 1), (8, [-1.0, 0.0], 9, 1)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int, bound int")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 7), (0, 2, 8)]


def test_a_scan_in_chunks_finds_what_one_chunk_finds():
    rng = np.random.default_rng(9)
    x, q = rng.standard_normal((3000, 40)), rng.standard_normal((7, 40))
    x[100:130] = x[100]
    q[0] = x[100]
    ids, asked = np.arange(3000), np.arange(5000, 5007)
    rot = nearest.rotation(40)
    both = []
    for size in (3000, 170):
        scan = nearest.Scan(q, asked, np.full(7, np.inf), rot, 5)
        for a in range(0, 3000, size):
            scan.add(x[a : a + size], ids[a : a + size])
        both.append(scan.found())
    u, w = nearest.unit(x), nearest.unit(q)
    best = [(int(asked[i]), int(j)) for i in range(7) for j in np.lexsort((ids, -(u @ w[i]).round(12)))[:5]]
    for got in both:
        assert len({(a, b) for a, b, _ in got} & set(best)) >= 0.9 * len(best) and [b for a, b, _ in got[:5]] == [100, 101, 102, 103, 104]


def test_queries_far_from_all_lists_get_all_their_neighbours(spark):
    """Nearly all rows crowd into one list, and the lists probed first are empty or small."""
    rng = np.random.default_rng(2)
    x = np.vstack([np.tile([1.0, 0, 0, 0], (3000, 1)), rng.standard_normal((40, 4))])
    got = nearest.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=20, lists=40, probes=1).groupBy("query_id").count().collect()
    assert len(got) == 152 and {r["count"] for r in got} == {5}


# ---- 7 WARC

def test_archives_come_back(spark):
    big = "<html>" + "wide " * 60 + "</html>"
    rows = [(3, "http://a/\r\nx: y", big), (1, "http://b", big), (2, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", "ä" * 50), (8, "u", "ä" * 50), (9, "v", "z" * 300_000), (None, "n", big)] + [(100 + i, "u", f"<p>{i}</p>" * 90) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    from strataforge.llm.common import scratch

    folder = scratch(spark, "t")
    archives = warc.write_archives(warc.plan_records(pages), folder)
    got = {r["page_id"]: r for r in warc.read_archives(archives, folder).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        if r["record_type"] == "response":
            assert r["payload"] == raw and r["refers_to"] is None
    assert {i: got[i]["refers_to"] for i in (3, None, 8)} == {3: 1, None: 1, 8: 7}
    assert all(got[i]["record_type"] == "response" for i in (1, 2, 4, 5, 6, 7, 9))
    assert warc.read_archives(warc.write_archives(warc.plan_records(pages.where("false")), folder), folder).count() == 0


def test_bad_archives_are_refused():
    import zstandard

    raw = warc.record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None, False)
    z = zstandard.ZstdCompressor(write_content_size=True).compress(raw)
    assert [warc.parse(x)["page_id"] for x in warc.records(iter([z[:7], z[7:] + z]))] == [1, 1]
    for bad in (z[:-3], z + b"\x01\x02\x03\x04", z + z[:2]):
        with pytest.raises(ValueError):
            list(warc.records(iter([bad])))
    for bad in (raw.replace(b"abc", b"abd"), raw[:-1], raw.replace(b"WARC/1.1", b"WARC/9.1"), raw.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_archives_of_repeated_ids_and_clashing_columns(spark, tmp_path, monkeypatch):
    from strataforge.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = [(5, "u", "p" * 200, 1), (5, "u", "p" * 200, 1), (3, "v", "q" * 150, 1), (None, "w", "q" * 150, 1), (9, None, None, 1), (8, "x", "p" * 200, 1), (7, "x", "short", 1), (6, "x", "short", 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string, digest int").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.op7_warc(spark, str(tmp_path)).collect()), key=str)
    want = [(5, "response", None, 200)] * 2 + [(3, "response", None, 150), (None, "revisit", 3, 150), (9, "response", None, 0), (8, "revisit", 5, 200), (7, "response", None, 5), (6, "response", None, 5)]
    assert got == sorted(want, key=str)


# ---- 8 PII

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def brute_pii(t):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


PII = [
    "mail a.b@c.de, x@y and u@v.w%q@r.st é😀 z_@ok.org.", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.255.0 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 49927398716", "+1 (487) 555-7209 +12 +49 30 123456789012345 ++4912345678901)",
    "1234567812345670" * 3, None, "", "a@b.c@d.e@f.g", "+1+2 3", "5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5", "9" * 3000 + "@x.y", "1.1.1.1" * 300, "a" * 20_000 + "@b", "bank IBAN DE89370400440532013000 and GB00WEST12345698765432", "ssn 123-45-6789 or 123-45-6789" + " " * 60 + "987-65-4321",
]


def test_pii_against_python(spark):
    rng = random.Random(8)
    alphabet = "0123456789 0123.. --+()@ab@.%é"
    texts = PII + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    for r in pii.find(df).collect():
        want = brute_pii(texts[r["doc_id"]])
        assert [(s["start"], s["kind"], s["stop"]) for s in r["found"] if s["kind"] < 4] == want, texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[1] == i for x in want) for i in range(4)]
    more = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["found"] if s["kind"] >= 4] for r in pii.find(df).collect()}
    assert more[13] == [(4, 10)] and [k for k, _ in more[14]] == [5, 5]
    assert pii.find(df.where("false")).count() == 0


# ---- 9 GIF

def test_gif_round_trips_and_equal_texts(spark):
    rows = ODD + [(10, "é" * 64), (11, "t" * 64 * 1024 * 3), (12, "t" * 64), (13, "ends in zeros\0\0"), (14, "".join(map(chr, range(1, 1500))))]
    df = docs(spark, rows)
    media = gif.encode_texts(df)
    back = defaultdict(list)
    for r in gif.decode_frames(media).orderBy("doc_id", "frame").where("NOT doc_id <=> 4").collect():
        back[r["doc_id"]].append(bytes(r["samples"]))
    for i, t in rows:
        if i != 4:
            assert b"".join(back[i]) == padded(t)
    assert gif.digests(gif.encode_texts(docs(spark, []))).count() == 0


def padded(text):
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % 64 if raw else 64)


def plain_unlzw(data):
    """Eight-bit GIF codes, a bit at a time."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    at, width, table, prev, out = 0, 9, None, None, b""
    while True:
        code, at = int(bits[at : at + width][::-1], 2), at + width
        if code == 257:
            return out
        if code == 256:
            table, width, prev = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        now = table[code] if code < len(table) else prev + prev[:1]
        if prev is not None and len(table) < 4096:
            table.append(prev + now[:1])
        out, prev = out + now, now
        width = min(12, max(9, len(table).bit_length()))


def plain_gif(data):
    """Samples, histogram counts, images and their time of a stored text, by a plain reader of just this form."""
    palette, at, samples, total, images, shown = data[13 : 13 + 768], 13 + 768, b"", [0] * 24, 0, 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                packed, delay, index = data[at + 3], data[at + 4] + 256 * data[at + 5], data[at + 6]
                assert packed >> 2 == 2
            at += 2
        else:
            at += 11
        parts = b""
        while n := data[at]:
            parts, at = parts + data[at + 1 : at + 1 + n], at + 1 + n
        at += 1
        if parts.startswith(b"NETSCAPE") or len(parts) == 4 and data[at] == 0x2C:
            continue
        pixels, clear = plain_unlzw(parts), index if packed & 1 else None
        samples += bytes(0 if p == clear else p for p in pixels)
        for p in pixels:
            if p != clear:
                for c in range(3):
                    total[8 * c + (palette[3 * p + c] >> 5)] += 1
        images, shown = images + 1, shown + 10 * delay
    return samples, total, images, shown


def test_gif_query_by_brute_force(spark, tmp_path):
    import zlib

    rows = [*ODD, (20, " ".join(f"word{i % 50}" for i in range(14000))), (21, "z" * 64), (None, "same"), (None, "same"), (22, "".join(chr(i % 900 + 33) for i in range(9000)))]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = gif.op9_media_gif(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        raw = padded(t)
        data = gif.encode(raw, len(raw) - len((t or "").encode()))
        samples, total, images, shown = plain_gif(data)
        assert samples == raw
        want.append((i, len((t or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(data), hashlib.sha256(data).hexdigest(), ",".join(map(str, total)), images, shown))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert max(r["media_bytes"] / r["n_bytes"] for r in got if r["doc_id"] == 20) < 0.5


def test_null_media_and_other_columns(spark):
    media = gif.encode_texts(docs(spark, [(1, "a")])).selectExpr("doc_id", "7 AS frame", "n_bytes", "media").unionByName(spark.createDataFrame([(2, 0, None, None)], "doc_id long, frame int, n_bytes long, media binary"))
    got = {r["doc_id"]: r for r in gif.digests(media).collect()}
    assert got[1]["payload_bytes"] == 64 and got[2]["payload_bytes"] == 0 and got[2]["payload_sha256"] is None
    assert {r["doc_id"] for r in gif.decode_frames(media).collect()} == {1}


def test_gif_rules():
    """A hand-made file: own palette, transparency, disposal, interlacing."""
    import struct

    def image(x, y, w, h, index, control=b"", packed=0x80):
        pal = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
        data = gif.lzw(bytes(index))
        return control + b"\x2c" + struct.pack("<HHHHB", x, y, w, h, packed | 1) + pal + b"\x08" + gif._blocks(data)

    ctl = lambda disposal, clear=None: b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), 7, clear or 0) + b"\0"
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0, 0, 0)
    data = head + image(0, 0, 2, 2, [0, 0, 0, 0], ctl(1)) + image(0, 0, 2, 1, [1, 3], ctl(2, 3)) + image(1, 1, 5, 5, [2] * 25, ctl(3)) + image(0, 1, 1, 1, [1]) + b"\x3b"
    shots = [(f["canvas"][..., :3].tolist(), f["canvas"][..., 3].tolist(), f["start_ms"]) for f in gif.frames(data)]
    red, green, blue, none = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    assert shots[0][0] == [[red, red], [red, red]]
    assert shots[1][0] == [[green, red], [red, red]]
    assert shots[2][0] == [[none, none], [red, blue]] and shots[2][1][0] == [0, 0]
    assert shots[3][0] == [[none, none], [green, red]] and [s[2] for s in shots] == [0, 70, 140, 210]
    rows = list(range(11))
    order = [y for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, 11, s)]
    assert gif._deinterlaced(np.array(order)[:, None]).ravel().tolist() == rows
    with pytest.raises(ValueError):
        list(gif.frames(b"GIF90a" + data[6:]))


def test_lzw_with_full_tables():
    rng = np.random.default_rng(0)
    for a in (rng.integers(0, 256, 40_000), rng.integers(0, 4, 60_000), np.zeros(100_000, int)):
        a = a.astype(np.uint8)
        assert (gif.unlzw(gif.lzw(a.tobytes()), 8, len(a)) == a).all()


def test_lzw_streams_of_other_writers():
    """Codes by hand: two-bit pixels, a code defined by itself, a full table that is kept, missing pixels."""
    bits = lambda *pairs: gif._packed(np.array([c for c, _ in pairs]), np.array([w for _, w in pairs]))
    assert gif.unlzw(bits((4, 3), (1, 3), (6, 3), (6, 3), (2, 4), (5, 4)), 2, 6).tolist() == [1, 1, 1, 1, 1, 2]
    assert gif.unlzw(bits((4, 3), (3, 3), (5, 3)), 2, 1).tolist() == [3]
    for missing in (bits((4, 3), (3, 3)), bits((4, 3), (3, 3), (5, 3)), b""):
        with pytest.raises(ValueError):
            gif.unlzw(missing, 2, 3)
    with pytest.raises(ValueError):
        gif.unlzw(gif.lzw(bytes(5)), 8, 6)
    a = np.random.default_rng(3).integers(0, 256, 9000).astype(np.uint8)
    codes = [256, *a.tolist(), 257]  # only single bytes, without another clear code
    widths = np.concatenate([[9], gif._widths(8, 0, len(a) + 1)])
    assert (gif.unlzw(gif._packed(np.array(codes), widths), 8, len(a)) == a).all()
    with pytest.raises(ValueError):
        gif.unlzw(bits((256, 9), (65, 9), (400, 9)), 8, 4)


def test_lzw_of_small_palettes():
    """Images of 2 to 128 colours, each pixel named by its own code with a clear code before codes widen, or greedy."""
    rng = np.random.default_rng(4)
    for bits in range(2, 8):
        a = rng.integers(0, 1 << bits, 700).astype(np.uint8)
        own, codes = (1 << bits) - 2, []
        for at in range(0, len(a), own):
            codes += [1 << bits, *a[at : at + own].tolist()]
        codes.append((1 << bits) + 1)
        assert (gif.unlzw(gif._packed(np.array(codes), np.full(len(codes), bits + 1)), bits, len(a)) == a).all()
        table, w, greedy = {(x,): x for x in range(1 << bits)}, (), []
        for x in a.tolist():
            if (*w, x) in table:
                w = (*w, x)
                continue
            greedy.append(table[w])
            table[(*w, x)] = len(table) + 2
            w = (x,)
        greedy += [table[w], (1 << bits) + 1]
        assert (gif.unlzw(gif._packed(np.array(greedy), gif._widths(bits, 0, len(greedy))), bits, len(a)) == a).all()


# ---- 10 packing

TOKENS = ["don't STOP <|endoftext|> naïve İstanbul ΣΑΣ é \x1d x\x85y 中文 ½ ²", "'S 'LL it''s", "ß Éa—b…", "a b 123,45 <|x", "\x00\x01 q", "ÀÉÞß×÷ ÿ", "a!!'S 'x", "", "   ", "x" * 3000]


def test_ids_are_the_tokenizer_s():
    t = packing.tokenizer(packing.word_vocabulary())
    assert [a.tolist() for a in t(TOKENS)] == [t.whole.encode(x, add_special_tokens=False).ids for x in TOKENS]


@pytest.mark.parametrize("limits", [(4096, 1024, 4096), (64, 3, 64), (64, 5, 20)])
def test_packs_hold_all_and_keep_limits(limits):
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        tokens = rng.choice([1, 2, 30, 63, 64, 65, 500], n)
        loss = (tokens * rng.choice([0.0, 0.1, 0.3], n)).astype(int)
        seqs = packing.pack_group(tokens, loss, *limits)
        parts = defaultdict(list)
        for s in seqs:
            used = sum(x[2] for x in s)
            assert used <= limits[0] and (used == limits[0] or used & (used - 1) == 0) and len(s) <= limits[1]
            assert sum(loss[i] / tokens[i] * k for i, _, k in s) <= limits[2] + 1e-6
            for i, a, k in s:
                parts[i].append((a, k))
        for i in range(n):
            at = 0
            for a, k in sorted(parts[i]):
                assert a == at and k > 0
                at += k
            assert at == tokens[i]


def test_more_than_one_limit_decides(spark):
    """Documents of answers nearly alone, and of prompts: packed by tokens alone, sequences would hold too much loss."""
    rows = [(i, "short prompt\n" + "an answer of words " * 150) for i in range(60)] + [(100 + i, "a long prompt of words " * 120 + "\nyes") for i in range(60)]
    df = docs(spark, rows).repartition(1)
    share = {r["doc_id"]: r["s"] for r in df.select("doc_id", packing.answer_share(F.col("text")).alias("s")).collect()}
    assert share[0] > 0.95 and share[100] < 0.05

    def sequences(got):
        used, loss = Counter(), Counter()
        for r in got:
            used[r["sequence_id"]] += r["length"]
            loss[r["sequence_id"]] += share[r["doc_id"]] * r["length"]
        return used, loss

    used, loss = sequences(packing.pack(df).collect())
    full = [k for k, n in used.items() if n == packing.SEQUENCE]
    assert max(loss.values()) <= packing.MAX_LOSS + 40 and len(full) >= 0.8 * sum(used.values()) / packing.SEQUENCE
    _, free = sequences(packing.pack(df, loss_share=F.lit(0.0)).collect())
    assert max(free.values()) > packing.MAX_LOSS + 400
    # With few pieces allowed, that limit decides.
    pieces = Counter(r["sequence_id"] for r in packing.pack(df, segments=2).collect())
    assert max(pieces.values()) == 2


def test_pack_of_a_table(spark):
    rows = ODD + [(20 + i, t) for i, t in enumerate(TOKENS)]
    got = packing.pack(docs(spark, rows)).collect()
    t = packing.tokenizer(packing.word_vocabulary())
    want = Counter((i, len(ids) + 1) for (i, _), ids in zip(rows, t([x or "" for _, x in rows]), strict=True))
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    for r in got:
        if r["doc_id"] in (20, 21):
            ids = [*t.whole.encode(TOKENS[r["doc_id"] - 20], add_special_tokens=False).ids, 2]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert packing.pack(docs(spark, [])).count() == 0


def test_components_take_few_tasks_whatever_the_shuffle_partitions(spark):
    """What a join of the stars reads thrice is made once: the driver hears of each task."""
    from strataforge.llm.common import relieve

    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40) if i % 8 != 7], "a binary, b binary")
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    sc = spark.sparkContext
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        sc.setJobGroup("stars", "stars")
        got = {r["node"]: r["root"] for r in chosen_path.components(edges).collect()}
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("stars")]
        stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in j.stageIds]
        done = sum(s.numCompletedTasks for s in stages if s)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {bytes([i]): bytes([i // 8 * 8]) for i in range(40)}
    assert done < 850
    relieve(spark)
