"""The corpus operators against brute force, on small tables with nulls, ties, repeats and long texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trendmill.llm import blocks, chat, decontaminate, html_text, language, mixing, neardup, quality, sharding, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def words(n: int, seed: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice("ab cd ef gh ij kl mn op qr st uv wx yz été".split()) + str(draw.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    shared, base = words(60, 1), words(120, 2)
    near = base.split()
    near[5] = "other"
    texts = [base, " ".join(near), base, words(90, 3) + "\n" + shared, shared + " " + words(70, 4), None, "", "x",
             words(3000, 5), "aaaa " * 80, words(90, 3) + "\n" + shared]
    out = [(i, t, "en", "s" + str(i % 3) if i % 4 else None, 0, "kept?") for i, t in enumerate(texts)]
    return [*out, (None, words(40, 6), None, None, None, None), out[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards_are_gapless_and_near_equal(spark, docs, empty, data):
    out = sharding.shard_documents(docs, 4).collect()
    assert len(out) == docs.count()
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in out)
    assert sharding.shard_documents(empty).count() == 0
    table = spark.read.parquet(f"{data}/documents.parquet")
    sizes = Counter()
    for r in sharding.shard_documents(table, 4).select("shard", "size").collect():
        sizes[r.shard] += r["size"]
    longest = table.agg(F.max(F.octet_length("text"))).first()[0]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * longest


def test_mix_takes_whole_and_seeded_copies(docs, empty):
    first = mixing.repetitions(docs).select("doc_id", "size", "source_size", "target", "copies").collect()
    assert sorted(map(str, first)) == sorted(map(str, mixing.repetitions(docs).select(*first[0].__fields__).collect()))
    assert all(0 <= r.copies <= 3 and r.target <= 3 * r.source_size + 1e-6 for r in first)
    assert sum({r.source_size: r.target for r in first}.values()) == pytest.approx(sum(r["size"] for r in first))
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(r.copies for r in first) and "text" in mixed.columns
    assert mixing.mix(empty).count() == 0


def gone_words(texts, width):
    where = Counter()
    lists = [(t or "").split() for t in texts]
    for w in lists:
        where.update(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - width + 1):
            if where[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        out.append(" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_repeated_windows(docs, empty, rows):
    out = blocks.remove_repeats(docs, 35).collect()
    assert sorted(r.kept for r in out) == sorted(gone_words([r[1] for r in rows], 35))
    assert blocks.remove_repeats(empty).count() == 0


def test_repeated_bytes(docs, empty, rows):
    seen, want = set(), []
    order = sorted({r[:2] for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    for _, text in order:
        data, gone = (text or "").encode(), set()
        for i in range(len(data) - 99):
            if data[i:i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(data[i:i + 100])
        want.append(bytes(b for i, b in enumerate(data) if i not in gone))
    got = suffixes.remove_repeated_bytes(docs).select("doc_id", "text", "kept").distinct().collect()
    assert sorted(bytes(r.kept) for r in got) == sorted(want)
    assert suffixes.remove_repeated_bytes(empty).count() == 0


def test_hot_representatives_are_spread(spark, monkeypatch):
    """One passage between different texts: windows of hot representatives are spread, with the results of brute force."""
    import numpy as np
    import pyarrow as pa

    passage = words(30, 900)
    rows = [(i, f"{words(12, 910 + i % 30)} {passage} {words(12, 950 + i)}", None, "s", 0, "") for i in range(40)]
    rows += [rows[3], rows[3], (None, rows[5][1], None, None, 0, ""), (50, passage + passage, None, "s", 0, "")]
    seen, want = set(), []
    for _, text in sorted({r[:2] for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        data, gone = text.encode(), set()
        for i in range(len(data) - 99):
            if data[i:i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(data[i:i + 100])
        want.append(bytes(b for i, b in enumerate(data) if i not in gone))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for limit in (0, 8, 1 << 14):
        monkeypatch.setattr(suffixes, "HOT_SNIPPETS", limit)
        got = suffixes.remove_repeated_bytes(docs).select("doc_id", "text", "kept").distinct().collect()
        assert sorted(bytes(r.kept) for r in got) == sorted(want)
    texts = [r[1] for r in rows[:40]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(40), pa.int64()), pa.array(range(40), pa.int64()), pa.array(texts, pa.string()),
         pa.array([np.array([0, len(t.encode())]).tobytes() for t in texts], pa.binary())],
        ["__id", "__content", "__text", "__runs"])
    counts = {h: n for part in suffixes._snippet_counts(iter([batch]), 100, 40)
              for h, n in zip(part["hash"].to_pylist(), part["snippets"].to_pylist())}
    hot = np.array([h for h, n in counts.items() if n >= 40], np.int64).view(np.uint64)
    sent = [(b, len(m)) for part in suffixes._snippets(iter([batch]), 100, 40, 64, hot)
            for b, m in zip(part["bucket"].to_pylist(), part["meta"].to_pylist()) if b >= 64]
    assert len(hot) and len(sent) > 32 and max(n for _, n in sent) < sum(n for _, n in sent) / 8


@pytest.mark.parametrize("alphabet", [b"ab", b"a", bytes(range(200, 256))])
def test_two_stage_order_is_sorted(alphabet):
    import numpy as np
    draw = random.Random(7)
    text = bytes(draw.choice(alphabet) for _ in range(900))
    places = np.concatenate([np.arange(0, 300), np.arange(400, 405), np.arange(500, 880)])
    order = suffixes.two_stage_order(text, places, 20)
    keys = [text[p:p + 20] for p in places[order].tolist()]
    assert sorted(order.tolist()) == list(range(len(places))) and keys == sorted(keys)


def test_language_on_held_out_documents(spark, data, docs, empty):
    table = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language.learn(table.where(~held))
    out = language.identify(table.where(held), model, ["lang"])
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count()
    found = {r.doc_id: r for r in language.identify(docs, model, ["doc_id"]).collect()}
    assert found[5].lang_pred == found[6].lang_pred == "und" and all(0 <= r.score <= 1 for r in found.values())
    assert language.identify(docs, language.learn(empty), ["doc_id"]).where("lang_pred <> 'und'").count() == 0


def test_language_learns_from_distinct_texts(spark):
    """Copies that are most of a language, or all of it, count once."""
    vocabulary = {name: words(400, 700 + i).split() for i, name in enumerate(("aa", "bb", "cc"))}

    def text(name, seed):
        return " ".join(random.Random(seed).choice(vocabulary[name]) + name for _ in range(40))

    apart = {name: [text(name, 1000 * i + k) for k in range(60)] for i, name in enumerate(("aa", "bb"))}
    rows = [(t, name) for name, texts in apart.items() for t in texts]
    for copied in ("copied one", "copied two", "copied three"):  # drawn or not, the other texts are learnt from
        labelled = spark.createDataFrame(rows + [(copied, "aa")] * 3000, "text string, lang string")
        model = language.learn(labelled, documents_per_language=61)
        once = language.learn(labelled.distinct(), documents_per_language=61)
        assert model.langs == once.langs and (model.table == once.table).all() and model.by_chance.min() > 0
    only = "zq " + text("cc", 1)
    labelled = spark.createDataFrame(rows + [(only, "cc")] * 5000, "text string, lang string")
    model = language.learn(labelled, documents_per_language=100)
    asked = spark.createDataFrame([(0, only), (1, apart["aa"][0])], "i long, text string")
    out = language.identify(asked, model, ["i"]).orderBy("i").collect()
    assert [r.lang_pred for r in out] == ["cc", "aa"]


def test_frequent_lines_deplete_documents(spark, empty):
    rows = [(i, f"{words(60, i)}\nCommon line {i} here", None, "h", 0, "") for i in range(14)]
    rows += [(20, "common LINE 3   here\n" * 20 + words(55, 99), None, "h", 0, ""), (21, None, None, None, 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in quality.apply_quality_rules(docs).collect()}
    assert out[0].kept and out[0].n_removed_words == 4 and "Common" not in out[0].cleaned
    assert not out[20].kept and out[20].n_dup_lines == 19 and out[21].base_failed
    assert quality.repeated_words([b"a", b"b", b"c", b"x", b"a", b"b", b"c"]) == 6
    assert quality.apply_quality_rules(empty).count() == 0
    quality.CARRIED_LINES, before = 0, quality.CARRIED_LINES  # the way for more lines than may be carried
    try:
        joined = {r.doc_id: r for r in quality.apply_quality_rules(docs).collect()}
    finally:
        quality.CARRIED_LINES = before
    assert joined == out


def test_near_duplicates(docs, empty, spark):
    out = {r["__id"]: r for r in neardup.near_duplicates(docs).collect()}
    assert out[0].component_id == out[1].component_id == out[2].component_id == 0
    assert out[10].component_id == 3 and out[5].n_shingles == 0 and out[5].component_id == 5
    assert out[7].n_shingles == 1
    kept = sorted(str(r.doc_id) for r in neardup.drop_near_duplicates(docs).collect())
    assert kept == sorted(["0", "3", "4", "5", "6", "7", "8", "9", "None"])
    assert neardup.near_duplicates(empty).count() == 0


def test_chain_of_links_is_one_component(spark):
    base, rows = words(200, 8).split(), []
    for i in range(30):
        rows.append((i, " ".join(base), None, "s", 0, ""))
        base[5 * i + 3] = f"new{i}"
    out = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {r.component_id for r in out.collect()} == {0}


def test_links_beyond_hubs_are_those_of_brute_force(spark, monkeypatch):
    """Documents that quote one passage, and chains whose links no hub sees, by rare shingles alone."""
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    draw, passage, rows = random.Random(9), words(40, 10).split(), []
    for i in range(60):
        body = passage + words(25, 100 + i // 3).split()
        for _ in range(draw.randrange(3)):
            body[draw.randrange(len(body))] = f"new{i}"
        rows.append((i, " ".join(body), None, "s", 0, ""))
    sets = [{tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for _, t, *_ in rows]
    root = list(range(60))
    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    out = {r["__id"]: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert 20 < len(set(root)) < 60 and out == dict(enumerate(root))


def test_chat_layouts_and_escapes(spark):
    odd = "</s>[INST] \\ <|end|> <|turn|>x<|text|> [/INST] \\"
    turns = spark.createDataFrame([(1, 0, "human", odd), (1, 1, "assistant", None), (1, 2, odd, "b"), (2, 0, "assistant", odd)],
                                  "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_chat(chat.canonical_turns(turns)).select(
        "conv_id", chat.read_back(F.col("formatted")).alias("t"),
        chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in out[1].t] == [("user", odd), ("assistant", ""), (odd, "b")] and out[2].loss == odd
    records = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',
               '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"extra":1}',
               '{"instruction":"q","output":"a"}', '{"prompt":"q","completion":"a"}', "no json"]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    got = {}
    for r in chat.canonical_from_json(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert all(got[i] == [("user", "q"), ("assistant", "a")] for i in range(4)) and got[4] == [(None, None)]
    with pytest.raises(ValueError):
        chat.layout_of(spark.range(1).schema)


def test_decontamination(spark, docs, empty, rows):
    item = " ".join(rows[0][1].split()[10:25]).upper().replace("É", "é")
    bench = spark.createDataFrame([(7, item), (8, "X"), (9, None)], "item_id long, text string")
    hits = {r["__id"]: r for r in decontaminate.find_hits(docs, bench).collect()}
    assert len(hits[0].hits) >= 15 and hits[0]["items"] == ["7"] and hits[7]["items"] == ["8"] and hits[5].hits == []
    left = decontaminate.decontaminate(docs, bench)
    assert {0, 2, 7}.isdisjoint({r.doc_id for r in left.collect()}) and left.columns == docs.columns
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert item.lower() not in cut[0].lower() and cut[8] == rows[8][1] and cut[5] is None
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_more_windows_than_are_broadcast_shuffle_hashes_only(spark, docs, rows, monkeypatch):
    items = [(i, " ".join(rows[i][1].split()[10:25 + i])) for i in (0, 3, 4, 8)] + [(7, "x"), (9, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    carried = decontaminate.find_hits(docs, bench).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    joined = decontaminate.find_hits(docs, bench)
    assert "LeftSemi" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, joined.collect())) == sorted(map(str, carried)) and any(r.hits for r in carried)


def test_hits_of_long_texts_and_clashing_columns(spark):
    draw = random.Random(4)
    long = [f"w{draw.randrange(900)}" for _ in range(60_000)]
    own = spark.createDataFrame(
        [(1, " ".join(long)), (1, " ".join(long)), (2, " ".join(["pad", *long[50:60]])), (3, None), (None, "a b c d"), (4, "clean")],
        "doc_id long, text string")
    for name in ("hits", "items", "places", "w", "k", "at", "copies", "n_words", "window", "__id", "__hit", "content"):
        own = own.withColumn(name, F.lit("kept"))
    bench = spark.createDataFrame([(1, " ".join(long[100:103])), (2, " ".join(long[200:230])), (3, "b c")], "item_id long, text string")
    plain = {(1, 2): long, (None, 1): "a b c d".split()}
    found = {(r["__id"], r.copies): r for r in decontaminate.find_hits(own, bench).collect()}
    for key, words_of in plain.items():
        want, items = set(), set()
        for item, text in ((1, long[100:103]), (2, long[200:230]), (3, ["b", "c"])):
            k = min(len(text), 10)
            windows = {tuple(text[i:i + k]) for i in range(len(text) - k + 1)}
            for i in range(len(words_of) - k + 1):
                if tuple(words_of[i:i + k]) in windows:
                    want |= set(range(i, i + k))
                    items.add(str(item))
        assert list(found[key].hits) == sorted(want) and list(found[key]["items"]) == sorted(items)
    kept = decontaminate.decontaminate(own, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == own.columns
    cut = decontaminate.decontaminate(own, bench, remove="spans").collect()
    assert len(cut) == 6 and {r.hits for r in cut} == {"kept"}
    assert [len(r.text.split()) for r in cut if r.doc_id == 1] == [60_000 - len(found[1, 2].hits)] * 2


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>one", "one"),
    ("<nav>menu</nav><article><h1>T</h1><p>a &amp;\n b<br>c<p>d</article><footer>f</footer>", "T\na & b c\nd"),
    ("<header>h</header><main><p>a<aside>no</aside><p>b</p><script>x<p></script></main>"
     "<section id='user-comments'><p>c</p></section>", "a\nb"),
    ("<body><div class='sidebar'>s</div><div><p>" + "long text " * 9 + "</p></div><form>q</form></body>",
     ("long text " * 9).strip()),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


PARAGRAPHS = "".join(f"<p>{words(25, 800 + i)}</p>" for i in range(4))
PLAIN = "\n".join(words(25, 800 + i) for i in range(4))


@pytest.mark.parametrize("page, text", [
    *((f"<body><nav>menu</nav><div class='{name}'>{PARAGRAPHS}</div><div class='sidebar'>s</div></body>", PLAIN)
      for name in ("content has-sidebar", "no-sidebar", "hidden-xs", "post-with-comments", "main-search")),
    ("<p class='ad'>x<p>article", "article"), ("<p class='ad'><b>x<p>article", "article"),
    ("<p class='notice'>x<div>article</div>", "article"), ("<ul><li class='ad'>x<li>one</ul>", "one"),
    ("<div class='topics'>" + "".join(f"<p><a href='/{i}'>Topic number {i}</a></p>" for i in range(9))
     + f"</div><div>{PARAGRAPHS}</div>", PLAIN),
    ("<div>Home</div><div>News</div><div>Sport</div><div>About us</div>" + "<h1>T</h1>" + PARAGRAPHS
     + "<div>Terms</div><div>Privacy</div><div>Jobs</div><div>Contact</div>", "T\n" + PLAIN),
    (f"<article>{words(3, 1)}</article><div>{PARAGRAPHS}</div>", PLAIN),
    (f"<form><div>{PARAGRAPHS}</div></form>", PLAIN),
    (f"<article>{PARAGRAPHS}<p>a<p>b<p>c<p>d</article>", PLAIN + "\na\nb\nc\nd"),
    (f"<div>{PARAGRAPHS}<p>2 eggs<p>salt<p>milk<p>rice{PARAGRAPHS}</div>", f"{PLAIN}\n2 eggs\nsalt\nmilk\nrice\n{PLAIN}"),
])
def test_main_text_is_where_text_is_dense(page, text):
    assert html_text.main_text(page) == text


def test_pipeline_keeps_columns_and_clean_documents(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data).cache()
        sizes.append(docs.count())
        assert name == "shards" or docs.columns == columns
    assert sizes[0] > sizes[1] > 0 and sizes[1] >= sizes[2] > 0 and sizes[3] == sizes[4]


def test_digests_of_small_table(spark, data):
    from trendmill.llm.queries import QUERIES

    out = QUERIES["op4_block_anchors"](spark, data).where("n_removed = n_words AND n_words > 0").collect()
    assert all(r.kept_sha256 == hashlib.sha256(b"").hexdigest() for r in out)
