"""The pipeline's stages against plain Python on a planted table, and tables with clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trendmill.llm import blocks, decontaminate, html_text, language, mixing, neardup, quality, sharding, suffixes

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


BENCH = [("q1", prose(900, 14)), ("q2", prose(901, 4)), ("q3", None), ("q4", "")]


def planted():
    """Clean documents of four sources, copies, near copies, benchmark passages, frequent lines, null and empty texts."""
    frequent = "frequent line " + prose(500, 30)
    rows = [(i, prose(i, 60 + i % 9), "s" + str(i % 3) if i % 4 else None) for i in range(80)]
    rows += [(100 + i, rows[i][1], "s1") for i in range(6)]  # exact copies
    for i in range(6, 14):  # one word of sixty-odd changed: similar by five-word shingles; twenty: not
        words = rows[i][1].split()
        for at in [30] if i < 10 else range(0, 60, 3):
            words[at] = "changed"
        rows.append((200 + i, " ".join(words), "s2"))
    rows += [(300, prose(300, 60) + " " + BENCH[0][1].upper(), "s0"), (301, prose(301, 70) + ", " + BENCH[1][1], "s0"),
             (302, prose(302, 70) + " " + " ".join(BENCH[0][1].split()[:9]), "s0")]  # nine words are no window
    rows += [(400 + i, prose(400 + i, 70 if i % 2 else 20) + "\n" + frequent, "hot") for i in range(30)]
    rows += [(500, None, "s0"), (501, "", "s0"), (502, "few words", "s0"), (503, "a b c " * 60, "s0")]
    rows += [(600, prose(600, 3000), "s1"), (80, prose(80, 55), "s1"), (80, prose(80, 55), "s1")]
    return [(i, t, "en", s, None if t is None else len(t), f"x{i}") for i, t, s in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output rows, each stage fed with what the one before wrote."""
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(BENCH, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(planted(), SCHEMA).repartition(5)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        given = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, folder)
        out[name] = given, docs.columns, [tuple(r) for r in docs.collect()]
        path = f"{folder}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def test_quality_rules(stages):
    given, columns, found = stages["quality_rules"]
    lines = lambda text: {x for x in (text or "").split("\n") if SPACE.search(x)}
    contents, seen = defaultdict(set), defaultdict(set)
    for row in given:
        contents[row[3]].add(row[1])
        for line in lines(row[1]):
            seen[row[3], line].add(row[1])
    often = {k for k, texts in seen.items() if len(texts) > 10 and len(texts) > 0.01 * len(contents[k[0]])}
    want = []
    for i, text, lang, source, _, extra in given:
        words = SPACE.findall(text or "")
        threes = Counter(zip(words, words[1:], words[2:]))
        repeated = {k + j for k in range(len(words) - 2) if threes[tuple(words[k:k + 3])] > 1 for j in range(3)}
        if len(words) < 50 or 100 * len(repeated) > 50 * len(words):
            continue
        left = "\n".join(x for x in text.split("\n") if (source, x) not in often)
        if len(SPACE.findall(left)) >= 0.5 * len(words):
            want.append((i, left, lang, source, len(left), extra))
    assert often and columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert ordered(found) == ordered(want) and len(found) < len(given)


def test_near_duplicates(stages):
    given, columns, found = stages["near_duplicates"]
    rows = list(dict.fromkeys(given))
    sets = []
    for row in rows:
        words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), row[1] or ""))
        sets.append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i])
    assert ordered(found) == ordered(min(g, key=lambda r: r[0]) for g in groups.values())
    assert len(given) - len(found) >= 11 and "extra" in columns


def test_decontamination(stages):
    given, _, found = stages["decontamination"]
    low = lambda text: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    windows = set()
    for _, text in BENCH:
        item = low(text)
        k = min(len(item), 10)
        windows |= {tuple(item[i:i + k]) for i in range(len(item) - k + 1)} if k else set()
    sizes = {len(w) for w in windows}

    def hit(words):
        return any(tuple(words[i:i + k]) in windows for k in sizes for i in range(len(words) - k + 1))

    assert ordered(found) == ordered(r for r in given if not hit(low(r[1])))
    assert {300, 301} & {r[0] for r in given} and not {300, 301} & {r[0] for r in found} and 302 in {r[0] for r in found}


def test_source_mix(stages):
    given, _, found = stages["source_mix"]
    size = {r: len(SPACE.findall(r[1] or "")) for r in given}
    per_source = Counter()
    for r in given:
        per_source[r[3]] += size[r]
    names = sorted(per_source, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, capped, total = {}, set(), sum(per_source.values())
    while True:
        rest = total - sum(3 * per_source[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * per_source[s] if s in capped else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * per_source[s]}
        if not over:
            break
        capped |= over
    times = Counter(found)
    assert set(times) <= set(given)
    for r in given:
        rate = target[r[3]] / per_source[r[3]]
        digest = hashlib.md5("|".join(["11", str(r[0]), r[1] or ""]).encode()).hexdigest()
        copies = int(rate) + (int(digest[:13], 16) / 2**52 < rate - int(rate))
        assert abs(times[r] - copies * given.count(r)) == 0


def test_shards(stages):
    given, columns, found = stages["shards"]
    assert columns[-3:] == ["size", "shard", "slot"] and ordered(r[:-3] for r in found) == ordered(given)
    assert all(r[-3] == len((r[1] or "").encode()) + 1 for r in found)
    per_shard = defaultdict(list)
    for r in found:
        per_shard[r[-2]].append(r)
    assert set(per_shard) <= set(range(16))
    largest = max(sum(r[-3] for r in found if r[:2] == x[:2]) for x in found)
    ideal = sum(r[-3] for r in found) / 16
    for rows in per_shard.values():
        assert sorted(r[-1] for r in rows) == list(range(len(rows)))
        assert abs(sum(r[-3] for r in rows) - ideal) <= 2 * largest + 1


@pytest.mark.parametrize("rows", ["none", "odd"])
def test_stages_take_empty_and_odd_tables(spark, data, rows):
    odd = [(None, None, None, None, None, None), (1, "", None, None, 0, "a"), (1, "", None, None, 0, "a"),
           (2, prose(1, 30000), None, "s", 5, "b")]
    docs = spark.createDataFrame(odd if rows == "odd" else [], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        kept = {r.doc_id for r in out.collect()}
        assert kept <= {None, 1, 2} and set(docs.columns) <= set(out.columns)
        if rows == "odd" and name == "quality_rules":
            assert kept == {2}


CLASHING = ["id", "content", "hits", "single", "size", "shard", "slot", "lang_pred", "score", "copies", "rate", "start", "key",
            "words", "window", "hash", "bucket", "item", "items", "component", "n_words", "kept", "host", "line", "removed",
            "__hit2", "at", "w", "k", "seen", "places", "n_chars", "label"]


def test_columns_with_clashing_names(spark):
    rows = [(i, prose(i % 5, 60), "en", "s") for i in range(8)] + [(None, None, None, None), (9, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    bench = spark.createDataFrame([("q", " ".join(prose(0, 60).split()[:12]))], "item_id string, text string")
    bench = bench.withColumns({c: F.lit("own") for c in ["window", "key", "width", "items", "words"]})
    model = language.learn(docs.where("text <> ''"))

    def own(out, *replaced):
        left = [c for c in CLASHING if c in out.columns and c not in replaced]
        assert len(left) >= len(CLASHING) - len(replaced)
        found = out.collect()
        assert all(r[c] == f"own {c}" for r in found for c in left)
        return len(found)

    assert own(sharding.shard_documents(docs, 4), "size", "shard", "slot") == 10
    assert own(mixing.mix(docs), "size", "rate", "copies") > 0
    assert own(neardup.drop_near_duplicates(docs)) == 7
    assert own(decontaminate.decontaminate(docs, bench)) == 8
    assert own(decontaminate.decontaminate(docs, bench, remove="spans")) == 10
    assert own(quality.apply_quality_rules(docs), "n_words", "kept") == 10
    assert own(blocks.remove_repeats(docs), "n_words", "kept") == 10
    assert own(suffixes.remove_repeated_bytes(docs), "kept") == 10
    assert own(html_text.extract_main_text(docs, [c for c in docs.columns if c != "text"], "text"), "n_chars") == 10

    assert own(language.identify(docs, model, docs.columns), "lang_pred", "score") == 10
