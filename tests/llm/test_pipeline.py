"""Each stage, and the whole run, against plain counterparts."""

import random
from collections import Counter, defaultdict

import corpus_pipeline as P
from curbline.llm import language, packing
from test_mixing import WORD, plain_targets
from test_signature_join import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, kept string, _row int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "k", 7) for i, t, lang, s in rows], SCHEMA)


def sample():
    draw = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randrange(8, 60))), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100 + k, rows[3][1], "de", "s1") for k in range(4)]  # exact copies
    rows += [(200 + k, rows[5][1] + f" end{k}", None, None) for k in range(4)]  # near copies
    rows += [(300, None, "en", "s0"), (301, "", None, "s1"), (302, "12 !! 34", "en", "s2"), (303, "der die das", "de", "s2")]
    rows += [(303, "der die das", "de", "s2"), (None, "no id here", "en", "s0")]
    return rows


def as_rows(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_language_stage_drops_texts_without_letters_only(spark):
    rows = sample()
    got = P.language_id(spark, frame(spark, rows), SF)
    assert got.columns == frame(spark, rows).columns
    assert as_rows(got) == Counter((i, t, s) for i, t, _, s in rows if any(c.isalpha() for c in t or ""))


def test_language_stage_without_labels_drops_texts_without_letters_only(spark):
    rows = [(i, t, None, s) for i, t, _, s in sample()]
    got = P.language_id(spark, frame(spark, rows), SF)
    want = Counter((i, t, s) for i, t, _, s in rows if any(c.isalpha() for c in t or ""))
    assert want and as_rows(got) == want


def test_exact_stage_keeps_the_largest_id(spark):
    rows = sample()
    best = {}
    for i, t, _, s in rows:
        key = t or ""
        if key not in best or (-1 if i is None else i) > (-1 if best[key][0] is None else best[key][0]):
            best[key] = (i, t, s)
    got = P.exact_dedup(spark, frame(spark, rows), SF)
    assert got.columns == frame(spark, rows).columns and as_rows(got) == Counter(best.values())


def test_near_stage_keeps_one_of_each_group(spark):
    rows = sample()
    got = P.near_dedup(spark, frame(spark, rows), SF)
    want = {c for i, n, c in brute([(i, t) for i, t, *_ in rows]) if n and c is not None}
    words = Counter(i for (i, t, _), k in as_rows(got).items() for _ in range(k) if WORD.search(t or "") and i is not None)
    assert words == Counter(want)
    wordless = [r for r in as_rows(got).elements() if not WORD.search(r[1] or "")]
    assert len(wordless) == sum(not WORD.search(t or "") for _, t, *_ in rows)


def test_mixing_stage_takes_the_targets(spark):
    rows = sample()
    got = P.mix(spark, frame(spark, rows), SF)
    assert got.columns == frame(spark, rows).columns
    sizes, taken = Counter(), Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    for r in got.collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    for s, want in plain_targets(sizes).items():
        assert abs(taken[s] - want) <= 0.5


def test_stages_of_an_empty_table(spark):
    docs = frame(spark, [])
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = P.run(spark, SF).collect()
    rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    last = {}
    for i, t, s in sorted(rows):
        last[t] = (i, t, s)
    first = {c for _, n, c in brute([(i, t) for i, t, _ in last.values()]) if n}
    kept = {i: (t, s) for i, t, s in last.values() if i in first}
    sizes = Counter()
    for t, s in kept.values():
        sizes[s] += len(WORD.findall(t))
    assert {r["doc_id"] for r in got} <= set(kept)
    target = plain_targets(sizes)
    encoder, ids = packing.Encoder(packing.vocabulary()), {}
    tokens, whole, bins = Counter(), Counter(), defaultdict(list)
    for r in got:
        tokens[kept[r["doc_id"]][1]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, (t, s) in kept.items():
        ids[i] = len(encoder.whole(t)) + 1
        whole[s] += ids[i]
    for s in target:  # as many tokens as the share of words taken asks for, about
        assert abs(tokens[s] / whole[s] - target[s] / sizes[s]) < 0.1
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 1024
    assert language.UNKNOWN == "und" and [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
