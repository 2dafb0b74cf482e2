"""Filter audit, tree BPE and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendmill.llm import bpe, interaction, queries, runs

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n int, ids string, runs string, good int, "
          "first int, digest string, id long, decoded string, __id int, E int")
SPACES = " \t\n\v\f\r"


def words_of(text):
    for sign in SPACES:
        text = (text or "").replace(sign, " ")
    return [w for w in text.split(" ") if w]


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", 0, 1, "x", "y", 2, 3, "z", 4, "d", 5, 6) for i, t, lang in rows], SCHEMA)


def corpus(seed: int = 1, n: int = 60):
    draw = random.Random(seed)
    vocabulary = "alpha Beta gamma DELTA eps été 日本 x#1 50% a b c".split()
    rows = []
    for i in range(n):
        text = " ".join(draw.choice(vocabulary) for _ in range(draw.choice([0, 3, 30, 150, 260])))
        if i % 3 == 0:
            unit = [draw.choice(vocabulary) for _ in range(draw.randint(1, 40))]
            text += "\n" + " ".join(unit * draw.randint(2, 5))
        rows.append((i, text, draw.choice(["en", "fr", None, ""])))
    copies = [(n + i, rows[i % 7][1], draw.choice(["en", "de"])) for i in range(25)]
    odd = [(500, None, "en"), (501, "", None), (502, " \n ", "xx"), (None, rows[3][1], "en"), (None, None, None), rows[2], rows[2],
           (503, "word " * 30_000, "en"), (504, "q" * 200_000, "xx")]
    return rows + copies + odd


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_filter_audit_equals_counting_one_document_at_a_time(spark, rows):
    labels = [(i, (i or 0) % 2, int((i or 0) % 5 == 0)) for i, _, _ in rows[:70]] + [(3, 0, 1), (None, 1, 1), (9999, 1, 1)]
    marks = {}
    for i, quality, toxic in labels:
        if i is not None:
            good, bad = marks.get(i, (0, 0))
            marks[i] = max(good, quality == 1), max(bad, toxic == 1)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    verdicts = []
    for i, t, lang in rows:
        body, own = t or "", words_of(t)
        fails = {"A": len(own) < 200, "B": 100 * len(set(own)) < 50 * len(own),
                 "C": 100 * sum("A" <= c <= "Z" for c in body) > 3 * len(body), "D": any(c in "#$%&*|" for c in body),
                 "E": i is not None and i > least[body]}
        verdicts.append((lang or "", fails, *marks.get(i, (0, 0))))
    want, removals = {}, Counter()
    for part in {v[0] for v in verdicts}:
        own = [v for v in verdicts if v[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [v for v in left if v[1][name]]
                left = [v for v in left if not v[1][name]]
                failing = [v for v in own if v[1][name]]
                alone = [v for v in failing if sum(v[1].values()) == 1]
                want[part, order, step] = [len(left), len(gone), len(failing) - len(gone), len(alone),
                                           sum(v[2] for v in gone), sum(v[3] for v in gone)]
                removals[part, name] += len(gone)
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(7))
    out = interaction.audit_filters(table(spark, rows).repartition(5), label_rows).collect()
    assert len(out) == len(want) == 600 * len({p for p, _, _ in want})
    for r in out:
        assert want[r.part, r.filter_order, r.step] == [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost]
        assert r.shapley == removals[r.part, r.filter_order[r.step - 1]] and r["filter"] == r.filter_order[r.step - 1]


def test_empty_tables_have_no_audit(spark, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit_filters(table(spark, []), labels).count() == 0
    assert {r.good_lost for r in interaction.audit_filters(table(spark, rows), labels).collect()} == {0}


def reference_coder():
    from tokenizers import Tokenizer
    return Tokenizer.from_str(bpe.tokenizer_text())


def test_joined_pieces_equal_whole_texts():
    coder, whole, draw = bpe.Coder(bpe.tokenizer_text()), reference_coder(), random.Random(7)
    signs = ["a", "the", " ", "  ", "\n", "'s", "'re", "'", "1", "--", "é", "日本語", " ", "　", "<|endoftext|>", "<|", "|>",
             "endof", "text", "́", "😀", "er", "\t", "Hello", " wor", "ld", "."]
    texts = ["", "a" * 3000, "-" * 2000, " " * 2500 + "x", "日" * 800, "'s" * 700, "a1" * 900, "<|endoftext|>" * 90]
    for _ in range(400):
        kind, n = draw.random(), draw.randint(1, 50)
        texts.append("".join(draw.choice(signs) * (1 if kind < 0.5 else draw.randint(1, 12)) for _ in range(n)))
        texts.append("".join(draw.choice("etaoinshrdlu") for _ in range(n * 8)))
    for leaf in (4, 13, 64, 1000):
        for text, ids in zip(texts, bpe.encode_texts(coder, [t.encode() for t in texts], leaf)):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, (leaf, text)


def test_any_ids_decode_as_the_library_does():
    coder, whole, draw = bpe.Coder(bpe.tokenizer_text()), reference_coder(), random.Random(5)
    for _ in range(300):
        ids = [draw.randrange(50257) for _ in range(draw.randrange(30))] + [draw.randrange(256) for _ in range(draw.randrange(9))]
        assert coder.decode(np.array(ids, np.int32)) == whole.decode(ids, skip_special_tokens=False)


def test_cuts_respect_signs_and_added_tokens():
    data = ("é" * 20 + "<|endoftext|>" * 5 + "😀" * 9).encode()
    cuts = bpe.halving(data, 0, len(data), 6, [b"<|endoftext|>"])
    assert cuts == sorted(set(cuts)) and 0 not in cuts and len(data) not in cuts
    for a, b in zip([0, *cuts], [*cuts, len(data)]):
        data[a:b].decode()
    assert sum(data[a:b].count(b"<|endoftext|>") for a, b in zip([0, *cuts], [*cuts, len(data)])) == 5


def test_encode_and_decode_whole_table(spark, rows):
    extra = [(600, "before <|endoftext|> after", "en"), (None, "q" * 100_000, "en"), (504, "q" * 200_000, "en")]
    whole = reference_coder()
    want = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, _ in rows + extra)
    for block in (bpe.BLOCK_BYTES, 500):  # the second sends most rows through the exchange
        out = bpe.decode(bpe.encode(table(spark, rows + extra).repartition(4), block=block)).collect()
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in out) == want
    assert bpe.encode(table(spark, [])).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None, "x"), (2, [], "y")], "a int, ids array<int>, decoded string")).collect() == [
        (1, None, ""), (2, [], "")]


def test_other_tokenizer_kinds_are_refused():
    import public_tokenizers
    with pytest.raises(ValueError):
        bpe.tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))


def all_runs(words, min_length=12):
    """Every period tried at every place."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        x = 0
        while x + q < len(words):
            y = x
            while y + q < len(words) and words[y] == words[y + q]:
                y += 1
            if y > x and y + q - x >= max(min_length, 2 * q):
                best.setdefault((x, y + q), q)
            x = max(y, x + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def test_runs_of_small_alphabets_are_complete():
    draw = random.Random(3)
    for _ in range(600):
        texts = []
        for _ in range(draw.randint(1, 4)):
            letters, size, own = draw.choice([1, 2, 2, 3, 5]), draw.randint(0, 90), []
            while len(own) < size:
                own += [draw.randrange(letters) for _ in range(draw.randint(1, 12))] * draw.randint(1, 6)
            if own and draw.random() < 0.4:
                own[draw.randrange(len(own))] = 9
            texts.append(own)
        first = np.cumsum([0] + [len(t) for t in texts])
        start, length, period = runs.find_periodic(np.repeat(np.arange(len(texts)), np.diff(first)),
                                                   np.array([w for t in texts for w in t], np.int64))
        for number, own in enumerate(texts):
            inside = (start >= first[number]) & (start < first[number + 1])
            found = sorted(zip((start[inside] - first[number]).tolist(), length[inside].tolist(), period[inside].tolist()))
            assert found == all_runs(own)


def planted(i, text):
    own = words_of(text)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g, n = h // 10, len(own)
    if h % 10 or not n:
        return own
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [own[a + (k - a) % p] if k >= a else own[k] for k in range(n)]


def test_periodic_query_equals_brute_force(spark, tmp_path):
    rows = [r for r in corpus(5, 200) if len(r[1] or "") < 20_000]
    table(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for i, t, _ in rows:
        own = planted(i, t)
        found = all_runs(own)
        lost = {k for s, n, q in found for k in range(s + q, s + n)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
        kept = " ".join(w for k, w in enumerate(own) if k not in lost)
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows) > 5


def test_long_and_clashing_rows_of_runs(spark, rows):
    out = {r.doc_id: r for r in runs.collapse_runs(table(spark, rows), keep=["doc_id", "id", "digest"]).collect()}
    assert out[503].collapsed == "word" and [tuple(r) for r in out[503].runs] == [(0, 30_000, 1)]
    assert out[500].n_words == 0 and out[502].collapsed == "" and out[504].n_runs == 0
    assert runs.collapse_runs(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        runs.collapse_runs(table(spark, rows), keep=["runs"])
