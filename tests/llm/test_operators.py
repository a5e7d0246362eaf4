"""The operators against brute force, exact round trips and planted cases, with odd rows and empty tables."""

import itertools
import json
import math
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import chat_format, decontaminate, inner_product, language_id, lm_score, pii, sentencepiece, substring_dup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5) for i, t, lang in rows], DOCS)


def words(rng, n, vocab):
    return [rng.choice(vocab) for _ in range(n)]


VOCAB = [f"{a}{b}{c}" for a in "bdfgklmn" for b in ("a", "e", "io") for c in ("rt", "st", "ng", "l", "m", "pt")]


# --- decontamination


def test_masks_find_every_accepted_window():
    n = decontaminate.WINDOW
    wrong = n - -(-n * decontaminate.MATCH // 100)
    fits = [{s + j for j in m} for m in decontaminate.MASKS for s in range(n - max(m))]
    assert max(map(max, decontaminate.MASKS)) + 1 == decontaminate.SPAN
    assert all(any(f.isdisjoint(c) for f in fits) for c in itertools.combinations(range(n), wrong))


def brute_contamination(docs, items):
    """Every diagonal, without seeds; items shorter than a window need a mask that fits or the whole run."""
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, t in docs:
        d = tok(t)
        for k, s in items:
            b = tok(s)
            w = min(decontaminate.WINDOW, len(b))
            for g in range(-len(b), len(d)):
                e = [int(d[p + g] == b[p]) for p in range(max(0, -g), min(len(b), len(d) - g))]
                if not w or len(e) < w or (best := max(sum(e[j : j + w]) for j in range(len(e) - w + 1))) * 100 < w * decontaminate.MATCH:
                    continue
                found = len(b) >= decontaminate.WINDOW or all(e)
                found = found or any(all(e[q + j] for j in m) for m in decontaminate.MASKS for q in range(len(e) - max(m)))
                if found:
                    out[i, k] = max(out.get((i, k), (0,)), (sum(e), len(e), best))
    return out


def contaminated_texts(rng):
    items = [(k, " ".join(words(rng, n, VOCAB))) for k, n in enumerate((11, 14, 30, 60, 8, 1, 16))] + [(9, None), (10, "")]
    docs = [(100, None, "en"), (101, "", "en"), (102, "x", "en"), (103, items[2][1] + " " + " ".join(words(rng, 4000, VOCAB)) + " " + items[4][1], "en")]
    for i in range(120):
        body = words(rng, 80, VOCAB)
        if i % 2:
            part = items[i % 7][1].split()
            part = [rng.choice(VOCAB) if rng.random() < 0.2 else w for w in part[: rng.randint(9, len(part)) if len(part) > 9 else None]]
            body[20:20] = part
        docs.append((i, ", ".join(body).upper(), "en"))
    return [*docs, docs[5], docs[5]], items


def test_decontamination_matches_brute_force(spark):
    docs, items = contaminated_texts(random.Random(1))
    got = decontaminate.contamination(table(spark, docs), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, matched int")).collect()
    want = brute_contamination([d[:2] for d in docs], items)
    assert {(r["doc_id"], r["item_id"]): (r["matched"], r["overlap"], r["best"]) for r in got} == want
    assert len(got) == len(want) > 20 and {4, 5, 6} <= {k for _, k in want}


def test_decontamination_sql_knows_short_items_too(spark):
    docs, items = contaminated_texts(random.Random(3))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", sorted({d[:2] for d in docs}, key=str))
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    got = {(r[0], r[1]): r[2:] for r in con.execute(decontaminate.ORACLE_SQL["op1_decontaminate"]).fetchall()}
    assert got == brute_contamination([d[:2] for d in docs], items)


def test_decontamination_drops_only_hits_and_keeps_columns(spark):
    rng = random.Random(2)
    item = " ".join(words(rng, 20, VOCAB))
    docs = table(spark, [(1, "a b " + item, "en"), (2, " ".join(words(rng, 50, VOCAB)), None), (None, item, "en"), (3, None, "en")])
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    out = decontaminate.decontaminated(docs, bench)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["2", "3", "None"]
    assert decontaminate.contamination(docs.where("false"), bench).collect() == []
    assert decontaminate.contamination(docs, bench.where("false")).collect() == []


# --- chat formatting


def test_calls_are_linked_ordered_and_validated(spark):
    calls = [
        (1, "a", 5, "add", '{"y": 2, "x": 1}'), (1, "b", 3, "add", '{"x": "$a", "y": 2}'), (1, "b", 9, "add", "{}"), (1, "c", 1, "add", '{"x": "$b", "y": [1], "z": 0}'),
        (1, "d", 7, "nope", "{}"), (1, "e", 8, "add", "not json"), (1, "f", 10, "add", '{"x": "$g", "y": 1}'), (1, "g", 11, "add", '{"x": "$f", "y": 1}'), (2, "a", 1, "add", '{"x": "$zz", "y": 1}'), (None, None, 1, "add", None),
    ]
    results = [(1, "a", 6, 'r"1'), (1, "a", 7, "r2"), (1, "c", 0, "early"), (3, "q", 2, None), (None, None, 2, "n")]
    tools = {"add": {"x": ("string", True), "y": ("integer", True)}}
    got = chat_format.linked_calls(spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string"), spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), tools)
    by = {(r["conv_id"], r["call_id"]): r for r in got.collect() if r["conv_id"]}
    assert {k[1]: v["status"] for k, v in by.items() if k[0] == 1} == {"a": "linked", "b": "unanswered", "c": "result_before_call", "d": "unanswered", "e": "unanswered", "f": "unanswered", "g": "unanswered"}
    assert by[3, "q"]["status"] == "orphan_result"
    assert by[1, "a"]["errors"] == ["x is no string"] and by[1, "c"]["errors"] == ["y is no integer", "unexpected z"] and by[1, "d"]["errors"] == ["unknown tool"] and by[1, "e"]["errors"] == ["not an object"]
    assert by[1, "b"]["valid"] and by[1, "b"]["n_calls"] == 2 and by[2, "a"]["errors"] == ["unknown reference"]
    order = sorted((v["release"], v["level"], v["turn"], k[1]) for k, v in by.items() if k[0] == 1 and not v["cyclic"])
    place = [x[3] for x in order]
    assert place.index("a") < place.index("b") < place.index("c")
    assert by[1, "f"]["cyclic"] and by[1, "g"]["cyclic"] and not by[1, "c"]["cyclic"]
    assert by[1, "a"]["canonical_json"] == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"r\\"1"}'
    assert json.loads(by[3, "q"]["canonical_json"]) == {"arguments": None, "id": "q", "name": None, "result": None}


def brute_order(calls):
    """release, level, cyclic by peeling in Python; calls: id -> (turn, refs)."""
    refs = {i: {r for r in rs if r in calls and r != i} for i, (_, rs) in calls.items()}
    done = {}
    while ready := [i for i in calls if i not in done and refs[i] <= set(done)]:
        for i in ready:
            release = max([calls[i][0], *(done[r][0] for r in refs[i])])
            done[i] = (release, max([done[r][1] + 1 for r in refs[i] if done[r][0] == release], default=0), False)
    return done | {i: (calls[i][0], 0, True) for i in calls if i not in done}


@pytest.mark.parametrize("limit", [500_000, -1])
def test_order_matches_peeling(spark, monkeypatch, limit):
    monkeypatch.setattr(chat_format, "BROADCAST_ROWS", limit)
    rng = random.Random(31)
    rows, want = [], {}
    for conv in range(25):
        n = 60 if conv == 7 else rng.randint(1, 12)
        calls = {f"k{i}": (rng.randint(0, n), [f"k{rng.randrange(n + 2)}" for _ in range(rng.choice([0, 0, 1, 1, 2]))]) for i in range(n)}
        rows += [(conv, i, t, json.dumps({f"a{k}": f"${r}" for k, r in enumerate(rs)})) for i, (t, rs) in calls.items()]
        found = brute_order(calls)
        for k, i in enumerate(sorted(calls, key=lambda i: (found[i][2], found[i][0], found[i][1], calls[i][0], i)), 1):  # noqa: B023
            want[conv, i] = (*found[i], k, any(r not in calls or r == i for r in calls[i][1]))
    rows.append((None, None, 1, "{}"))
    got = chat_format.ordered(spark.createDataFrame(rows, "conv_id long, call_id string, turn long, arguments string")).collect()
    assert {(r["conv_id"], r["call_id"]): (r["release"], r["level"], r["cyclic"], r["position"], r["unknown_reference"]) for r in got} == want


def test_the_query_reaches_every_case(spark):
    rng = random.Random(32)
    turns = [(c, t, "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2], "x" * rng.randint(0, 40)) for c in range(150) for t in range(8)]
    turns += [(500, 1, "assistant", None), (500, 2, None, "x"), (501, 0, "user", "x")]
    out = chat_format.linked_calls(*chat_format.calls_and_results(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")), chat_format.TOOLS).collect()
    assert {r["status"] for r in out} == {"linked", "unanswered", "orphan_result", "result_before_call"}
    assert any(r["cyclic"] for r in out) and any(r["release"] > r["turn"] for r in out) and any(r["n_calls"] > 1 for r in out) and any(r["errors"] for r in out)
    place = {(r["conv_id"], r["call_id"]): r["position"] for r in out if not r["cyclic"]}
    after = [((r["conv_id"], r["call_id"]), (r["conv_id"], json.loads(r["canonical_json"])["arguments"].get("after", "$")[1:])) for r in out if r["name"]]
    assert all(place[a] > place[b] for a, b in after if a in place and b in place and a != b) and sum(b in place for _, b in after) > 50


def test_chat_formatting_of_an_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.linked_calls(*chat_format.calls_and_results(turns), chat_format.TOOLS).collect() == []


# --- inner products


def test_inner_products_match_brute_force(spark):
    rng = np.random.default_rng(3)
    vecs = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).astype(float).tolist()) for i in range(400)]
    vecs += [(400 + i, vecs[7][1]) for i in range(20)] + [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")]), (None, [1.0]), (504, [0.5]), (505, []), (8, vecs[8][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vecs], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in inner_product.max_inner_products(df, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ok = {i: [math.floor(256 * x) for x in v] for i, v in vecs if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for a in (i for i in ok if i % 50 == 0):
        best = sorted((-sum(x * y for x, y in zip(ok[a], ok[b])), b) for b in ok if b != a)[:5]
        want[a] = {k: (b, -s) for k, (s, b) in enumerate(best, 1)}
    assert got == want


def test_inner_products_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in inner_product.max_inner_products(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 131072)]
    assert inner_product.max_inner_products(df.where("false"), F.col("vec_id") == 0).collect() == []
    assert inner_product.max_inner_products(df, F.lit(False)).collect() == []


# --- language


def test_language_of_held_out_texts_and_odd_rows(spark):
    rng = random.Random(4)
    langs = {"xx": ["ba", "la", "mi"], "yy": ["krz", "pst", "vlk"]}
    rows = []
    for i in range(120):
        lang = ("xx", "yy")[i % 2]
        rows.append((i, " ".join("".join(words(rng, 3, langs[lang])) for _ in range(30)), lang))
    rows += [(900, None, "xx"), (901, "123 !!", "xx"), (902, "bala " * 40_000, None), (903, "Krzpstvlk", None), (903, "Krzpstvlk", None)]
    got = {r["doc_id"]: r for r in language_id.language_id(table(spark, rows), F.col("doc_id") % 3 != 0).collect()}
    assert all(got[i]["lang_pred"] == ("xx", "yy")[i % 2] for i in range(120)) and got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert got[902]["lang_pred"] == "xx" and got[903]["lang_pred"] == "yy" and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.language_id(table(spark, rows).where("false"), F.lit(True)).collect() == []
    assert {r["lang_pred"] for r in language_id.language_id(table(spark, rows), F.lit(False)).collect()} == {"und"}


def brute_language(rows, held):
    """Word-first backoff as defined, over everything at once."""
    tok = lambda t: "".join(x if x.isalpha() else " " for x in (t or "").lower()).split()
    grams = lambda w, n: [f"\x02{w}\x03"[i : i + n] for i in range(len(w) + 3 - n)]
    count, gram = {}, {}
    for i, t, lang in rows:
        if lang is not None and not held(i):
            count.setdefault(lang, Counter()).update(tok(t))
    langs = sorted(lang for lang in count if count[lang])
    for lang in langs:
        gram[lang] = Counter(g for w in count[lang] for n in range(1, 5) for g in grams(w, n))
    v, g = len(set().union(*count.values())), len(set().union(*gram.values()))
    log = lambda c, x, n: [math.log((c[a][x] + 0.5) / (sum(c[a].values()) + n / 2)) for a in langs]
    out = {}
    for i, t, _ in rows:
        total = [0.0] * len(langs)
        for w in tok(t):
            if any(w in count[a] for a in langs):
                add = log(count, w, v)
            else:
                m, got = f"\x02{w}\x03", []
                for k in range(len(m)):
                    found = next((m[k : k + n] for n in range(min(4, len(m) - k), 0, -1) if any(m[k : k + n] in gram[a] for a in langs)), None)
                    if found:
                        got.append(log(gram, found, g))
                add = [sum(x) / len(got) for x in zip(*got, strict=True)] if got else [0.0] * len(langs)
            total = [a + b for a, b in zip(total, add, strict=True)]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        out[i] = (langs[best], 1 / sum(math.exp(x - total[best]) for x in total)) if tok(t) else ("und", 0.0)
    return out


@pytest.mark.parametrize("cells", [0, 60, 400_000])
def test_language_matches_brute_force_whatever_is_broadcast(spark, monkeypatch, cells):
    monkeypatch.setattr(language_id, "CELLS", cells)
    monkeypatch.setattr(language_id, "BROADCAST_GRAMS", 0 if cells == 60 else 200_000)
    monkeypatch.setattr(language_id, "FLUSH", 40)
    rng = random.Random(cells)
    syllables = {"aa": ["ba", "la", "mi", "ñu"], "bb": ["krz", "pst", "vlk", "ô"], "cc": ["ba", "vlk", "xu", "漢"]}
    rows = [(i, " ".join("".join(words(rng, rng.randint(1, 3), syllables[lang])) for _ in range(rng.randint(1, 12))), lang) for i, lang in enumerate("aa bb cc".split() * 40)]
    rows += [(500, "BALA Mi2ba _vlk_ ǅx", None), (501, "½ ² ①", "aa"), (502, None, "bb"), (503, "", None), (504, "ωψ ж", None), (505, "zzz " * 300, None)]
    held = lambda i: i % 4 == 2
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.language_id(table(spark, rows), F.col("doc_id") % 4 != 2).collect()}
    want = brute_language(rows, held)
    assert set(got) == set(want) and got[501] == ("und", 0.0)
    for i, (lang, score) in want.items():
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-6, i


# --- pieces


def test_pieces_round_trip_and_are_reproducible(spark):
    texts = ["Hello  world\n\tfoo", " lead", "", None, "▁ meta ▁▁", "é漢字😀‍ x\x00y", "x" * 70_000, "word " * 20_000, "   ", "²."]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    out = sentencepiece.encode(df, check=True)
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(r["lossless"] for r in got.values() if r["text"] is not None) and got[3]["piece_ids"] is None and got[2]["piece_ids"] == []
    assert {r["doc_id"]: r["text"] for r in sentencepiece.decode(out.drop("text")).collect()} == dict(enumerate(texts))
    again = {r["doc_id"]: r["piece_ids"] for r in sentencepiece.encode(df.repartition(3).orderBy(F.desc("doc_id"))).collect()}
    assert again == {i: r["piece_ids"] for i, r in got.items()}
    assert sentencepiece.encode(df.where("false")).collect() == []


def test_pieces_are_sampled_by_their_weight():
    m = sentencepiece.load()
    vocab = {bytes(m.raw[m.raw_end[i] - m.raw_len[i] : m.raw_end[i]]).decode(): (int(i), w) for i, w in zip(m.piece, m.weight, strict=True)}
    unit = " there"

    def paths(b):
        if b == len(unit):
            yield (), 1.0
        for e in range(b + 1, len(unit) + 1):
            if unit[b:e] in vocab:
                i, x = vocab[unit[b:e]]
                for p, y in paths(e):
                    yield (i, *p), x * y

    want = dict(paths(0))
    total, n = sum(want.values()), 40_000
    ids, heads, _ = m.encode(["there"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(heads[:-1], heads[1:], strict=True))
    assert all(abs(seen[k] / n - v / total) < 5 * math.sqrt(v / total / n) + 1e-4 for k, v in want.items())


def test_shares_of_a_unit_do_not_depend_on_its_neighbours(spark):
    def lattice(m, unit):
        c = sentencepiece.code_points(unit)
        last = int(m._lasts(c, np.array([0]), np.array([len(c)]))[0])
        first = int(last - len(c) + 1)
        edges = slice(m.first[first], m.first[last + 1] if last + 1 < m.nodes else m.edges)
        return m.share[edges].tobytes(), m.ids[edges].tobytes()

    rng = random.Random(4)
    units = [" " + "".join(rng.choice("abcdefghiéß漢") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    alone, together = sentencepiece.load(), sentencepiece.load()
    together.encode([u[1:] for u in units], np.arange(len(units), dtype=np.uint64))
    together.encode([u[1:] + " x" for u in reversed(units)], np.arange(len(units), dtype=np.uint64))
    for u in units:
        assert lattice(alone, u) == lattice(together, u)
    a, b = alone.encode(units, np.arange(300, dtype=np.uint64)), together.encode(units, np.arange(300, dtype=np.uint64))
    assert all((x == y).all() for x, y in zip(a, b, strict=True)) and a[2].all()
    long = sentencepiece.load().encode(["x" * 5000 + "\U0010ffff" * 3000], np.array([1], np.uint64))
    assert long[2].all()


def test_pieces_survive_a_shared_hash(monkeypatch):
    m = sentencepiece.load()
    m.known, m.last = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    real, calls = m.add, []

    def wrong(c, begins, ends):
        calls.append(len(begins))
        lasts = real(c, begins, ends)
        return np.full_like(lasts, lasts[0]) if len(calls) == 1 else lasts

    monkeypatch.setattr(m, "add", wrong)
    ids, heads, same = m.encode(["some other words", "here"], np.array([1, 2], np.uint64))
    assert same.all() and m.salt == 1 and [m.decode(ids[a:b]) for a, b in zip(heads[:-1], heads[1:], strict=True)] == ["some other words", "here"]


def test_pieces_keep_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "k", 5, "x", None), (None, None, None, None, None, None)], "doc_id long, text string, row_key string, c0 int, `a.b` string, lossless string")
    got = sentencepiece.encode(df, check=True)
    assert got.columns == ["doc_id", "text", "row_key", "c0", "a.b", "piece_ids", "lossless"]
    first = got.where("doc_id = 1").first()
    assert (first["row_key"], first["c0"], first["a.b"], first["lossless"]) == ("k", 5, "x", True) and sentencepiece.encode(df.drop("lossless")).columns[-1] == "piece_ids"


# --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, rx in BASE.items():
        for m in re.finditer(rx, text):
            d = re.sub(r"[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 12 <= len(d) <= 19 and luhn) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    alphabet = ["a", "Z", "9", "1", ".", "@", "+", "-", " ", "(", ")", "é", "_", "4111 1111 1111 1111", "1.2.3.4", "+1 (555) 123-4567", "a.b@c-d.org", "00012"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_revealing_terms_are_found_and_texts_sanitised(spark):
    rng = random.Random(6)
    rows = [(i, " ".join([*words(rng, 12, VOCAB), "zorblax", "ann@b.org", *words(rng, 12, VOCAB)]), "en") for i in range(8)]
    rows += [(20 + i, " ".join(words(rng, 40, VOCAB)), "en") for i in range(60)] + [(90, None, "en"), (91, "", "en"), (0, rows[0][1], "en")]
    docs = table(spark, rows)
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert all("term" in got[i]["spans"] and got[i]["n_email"] == 1 for i in range(8)) and all(got[i]["spans"] == "" for i in range(20, 80))
    assert got[90]["spans"] == got[91]["spans"] == "" and pii.find_pii(docs).count() == len(rows)
    clean = {r["doc_id"]: r for r in pii.sanitised(docs).collect()}
    assert all("zorblax" not in clean[i]["text"] and "[EMAIL]" in clean[i]["text"] and clean[i]["n_chars"] == len(clean[i]["text"]) for i in range(8))
    assert clean[25]["text"] == dict((i, t) for i, t, _ in rows)[25] and clean[90]["text"] is None and pii.sanitised(docs).columns == docs.columns
    assert pii.find_pii(docs.where("false")).collect() == [] and pii.sanitised(docs.where("false")).collect() == []


def test_copies_of_a_text_count_once_beside_a_value(spark):
    rng = random.Random(16)
    rows = [(i, " ".join([*words(rng, 12, VOCAB), "zorblax", "ann@b.org", *words(rng, 12, VOCAB)]), "en") for i in range(4)]
    rows += [(10 + i, rows[0][1], "en") for i in range(300)]
    rows += [(1000 + i, " ".join(words(rng, 40, VOCAB)), "en") for i in range(60)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(table(spark, rows)).collect()}
    assert len(got) == len(rows) and all("term" in got[i] for i in [*range(4), *range(10, 310)])


def brute_disclosing(texts):
    """Of each distinct text the places (first, last, removed) of disclosing terms, by the definition."""
    near, total, held = Counter(), Counter(), {}
    around = Counter()
    for t in set(texts):
        base = brute_spans(t)
        terms = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t)]
        total.update(t[b:e].lower() for b, e in terms)
        free = lambda p: all(p[1] <= b or e <= p[0] for b, e, _ in base)  # noqa: E731, B023
        for b, e, kind in base:
            v = f"{kind}:{t[b:e].lower()}"
            for x, y in [p for p in terms if p[1] <= b][-pii.RADIUS :] + [p for p in terms if p[0] >= e][: pii.RADIUS]:
                if free((x, y)):
                    held.setdefault((v, t[x:y].lower()), set()).add((t, x, y))
    for (v, w), places in held.items():
        near[v, w] = len(places)
        around[v] += len(places)
    n, out = sum(total.values()), {t: {} for t in texts}
    for (v, w), places in held.items():
        p = min(around[v] / n, 0.5)
        strength = 1 + math.log2(near[v, w] / max(near[v, w], total[w] + pii.SHRINK)) / -math.log2(p)
        if strength >= pii.GENERALISE:
            for t in {t for t, *_ in places}:
                base = brute_spans(t)
                for m in re.finditer(r"[^\W\d_]{3,}", t):
                    if m[0].lower() == w and all(m.end() <= b or e <= m.start() for b, e, _ in base):
                        out[t][m.start(), m.end()] = out[t].get((m.start(), m.end()), False) or strength >= pii.REMOVE
    return {t: sorted((*k, v) for k, v in x.items()) for t, x in out.items()}


@pytest.mark.parametrize("limit", [500_000, -1])
def test_disclosed_terms_match_their_definition(spark, monkeypatch, limit):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", limit)
    rng = random.Random(17)
    values = ["ann@b.org", "10.0.0.7", "+49 (30) 123456-78", "bob@c.net", "4111 1111 1111 1111"]
    names = ["zorblax", "Quinted", "vhauz", "ümlautig"]
    rows = []
    for i in range(150):
        body = words(rng, rng.randint(5, 60), VOCAB)
        for _ in range(rng.randint(0, 3) if i % 3 == 0 else 0):
            k = rng.randrange(len(values))
            body.insert(rng.randint(0, len(body)), f"{names[k % 4]} {values[k]}")
        if i % 5 == 0:
            body.append(rng.choice([*names, "onceword" + "abc"[i % 3] * i]))
        rows.append((i, " ".join(body), "en"))
    rows += [(500 + i, rows[3][1], "en") for i in range(30)] + [(600, None, "en"), (601, "", "en"), (602, "lone hapaxa 1.2.3.4 " + "- 7 " * 3000 + "farawayword", "en")]
    rows += [(700 + i, " ".join(words(rng, 400, VOCAB)), "en") for i in range(100)]
    want = brute_disclosing([t for _, t, _ in rows if t])
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(table(spark, rows)).collect()}
    for i, t, _ in rows:
        spans = sorted([*brute_spans(t or ""), *((b, e, "term") for b, e, _ in want.get(t, []))], key=lambda s: (s[0], pii.KINDS.index(s[2])))
        assert got[i] == ",".join(f"{k}:{b}:{e}" for b, e, k in spans), t
    assert sum(map(len, want.values())) > 15 and len(want[rows[-101][1]]) == 3
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(table(spark, rows)).collect()}
    assert all(t == clean[i] for i, t, _ in rows if not t or not (brute_spans(t) or want[t])) and "hapaxa" not in clean[602]


def test_sanitised_keeps_clashing_columns(spark):
    names = ["key", "places", "salt of the key", "near", "c1", "a.b"]
    df = spark.createDataFrame([(1, "mail ann@b.org", *names), (2, None, *[None] * 6)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = {r["doc_id"]: r for r in pii.sanitised(df).collect()}
    assert pii.sanitised(df).columns == df.columns and [got[1][n] for n in names] == names and got[1]["text"].endswith("[EMAIL]") and got[2]["text"] is None


# --- language model


def test_counts_and_base_scores(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(words(rng, rng.choice([1, 5, 900]), VOCAB)).title(), "en") for i in range(60)] + [(70, None, "en"), (71, "", "en"), (72, "unseen\tword", "en"), (3, None, "en")]
    rows += [rows[5], rows[5]]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = Counter(w for i, t, _ in rows if not held(i) for w in tok(t))
    total, distinct = sum(c.values()), len(c)
    got = lm_score.hmm_scores(table(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    assert len(got) == len(rows)
    want = Counter((i, len(tok(t)), sum(c[w] > 0 for w in tok(t)), total, round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in tok(t)), 6)) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["held_out"] == held(r["doc_id"]) for r in got)
    assert lm_score.hmm_scores(table(spark, rows).where("false"), F.lit(False)).collect() == []
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 for r in lm_score.hmm_scores(table(spark, rows), F.lit(True)).collect())


def test_forward_likelihood_is_exact_and_training_raises_it():
    rng = np.random.default_rng(8)
    n = lm_score.SUFFIXES
    classes = lm_score.Classes(np.array([5, 9], np.uint64), np.array([30, 40]), np.zeros(n), np.zeros(n), 20, 90, 3)
    model = lm_score.Model(np.array([0.3, 0.7]), np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.2, 0.8]]), rng.random((classes.size, 2)))
    lens = [1, 2, 512, 513, 700, 1300]
    heads = np.concatenate([[0], np.cumsum(lens)])
    seq = rng.integers(0, 10, heads[-1])
    got = lm_score.log_likelihood(model, seq, heads)
    for k in range(len(lens)):
        a, s = model.start * model.emit[seq[heads[k]]], 0.0
        for x in seq[heads[k] + 1 : heads[k + 1]]:
            a = (a @ model.move) * model.emit[x]
            s += math.log10(a.sum())
            a /= a.sum()
        assert got[k] == pytest.approx(s + math.log10(a.sum()), rel=1e-9)
    seq = np.tile(np.repeat([0, 1], 20), len(seq) // 40 + 1)[: heads[-1]]
    model, last = lm_score.fresh(classes, 2), -np.inf
    for _ in range(6):
        sums = lm_score.nothing(model)
        lm_score.expect(model, seq, heads, sums)
        assert sums["log"] > last - 1e-6
        last, model = sums["log"], lm_score.estimated(sums, classes)


# --- toxicity


def brute_maximal(scores):
    """Maximal scoring subsequences by their definition: the best, then those on its left and right."""

    def best(lo, hi):
        top = None
        for i in range(lo, hi):
            total = 0
            for j in range(i, hi):
                total += scores[j]
                if total > 0 and (top is None or total > top[2]):
                    top = (i, j + 1, total)
        return top

    todo, out = [(0, len(scores))], []
    while todo:
        lo, hi = todo.pop()
        if t := best(lo, hi):
            out.append(t)
            todo += [(lo, t[0]), (t[1], hi)]
    return sorted(out)


def test_segments_are_the_maximal_ones():
    rng = random.Random(9)
    for _ in range(300):
        hot = {"x": 3.0, "y": 1.0, "z": -2.5}
        s = toxicity.Scorer(hot, {}, -0.7)
        text = [rng.choice(["x", "y", "z", "o", "o", "o"]) for _ in range(rng.randint(0, 30))]
        got = [(b, e, round(v, 9)) for b, e, v in s.segments(text)]
        want = [(b, e, round(v, 9)) for b, e, v in brute_maximal([hot.get(w, -0.7) for w in text])]
        assert sum(v for *_, v in got) == pytest.approx(sum(v for *_, v in want)) and len(got) == len(want)


def test_the_start_of_the_model_comes_from_all_texts(spark, monkeypatch):
    """The start alone. Texts of 25,000 characters and more in two languages without common words: a model that tells them apart gains log10(2) a
    token, less where rarer words of both share a group."""
    monkeypatch.setattr(lm_score, "PASSES", 0)
    rng = random.Random(25)
    rows = [(i, " ".join(words(rng, 5000, [f"{'ab'[i % 2]}{k}x" for k in range(300)])), "en") for i in range(40)]
    got = lm_score.hmm_scores(table(spark, rows), F.lit(False)).collect()
    gain = sum(r["score"] - r["base_score"] for r in got) / sum(r["n_tokens"] for r in got)
    assert gain > 0.2, gain


def test_toxic_texts_score_high_and_clean_ones_low(spark):
    rng = random.Random(10)
    bad = ["vileoaf", "vileoafen", "grotter", "grotters"]
    rows = [(i, " ".join(w if rng.random() > 0.1 or i % 4 else rng.choice(bad) for w in words(rng, 60, VOCAB)), "en") for i in range(400)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "!!", "en"), (903, "good " * 30_000, "en")]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels, F.col("doc_id") % 5 != 0).collect()}
    held = [i for i in range(0, 400, 5)]
    assert sum((got[i]["toxic_score"] >= 0.3) == (i % 4 == 0) for i in held) >= len(held) - 2
    assert all(got[i]["toxic_score"] < 0.3 and got[i]["n_segments"] == 0 for i in (900, 901, 902, 903))
    kept = toxicity.without_toxic(docs, labels, F.col("doc_id") % 5 != 0, 0.3)
    assert kept.columns == docs.columns and kept.where("doc_id >= 900").count() == 4
    assert toxicity.toxicity(docs.where("false"), labels, F.lit(True)).collect() == []
    assert {r["toxic_score"] for r in toxicity.toxicity(docs, labels.where("false"), F.lit(True)).collect()} == {0.0}


# --- repeated passages


def test_windows_cover_every_subsequence_once_by_its_two_least_tokens():
    rng = np.random.default_rng(11)
    tokens = rng.integers(0, 2**63, 40).astype(np.uint64)
    heads, least = np.array([0, 0, 25, 40]), 6
    rows, keys, places = substring_dup.windows(tokens, heads, least, 0)
    assert (places < np.diff(heads)[rows]).all()
    low = np.uint64(0xFFFFFF)
    h = [(substring_dup.mix(tokens ^ substring_dup.mix(np.array([f + 1], np.uint64))) & ~low) for f in range(2)]
    want = set()
    for r in range(3):
        for i in range(heads[r], heads[r + 1]):
            for j in range(i + least, heads[r + 1] + 1):
                a, b = h[0][i:j].min(), h[1][i:j].min()
                want.add((r, int(substring_dup.mix(np.array([a + substring_dup.mix(np.array([b], np.uint64))[0]], np.uint64))[0])))
    assert {(int(r), int(k)) for r, k in zip(rows, keys, strict=True)} == want


def test_planted_passages_are_found_and_others_are_not(spark):
    rng = random.Random(12)
    wide = [f"w{i}" for i in range(5000)]
    exact, near, short = words(rng, 60, wide), words(rng, 120, wide), words(rng, 40, wide)
    rows = [(i, " ".join(words(rng, 200, wide)), "en") for i in range(40)]
    rows += [(100 + i, " ".join([*words(rng, 30 + i, wide), *exact, *words(rng, 50, wide)]), "en") for i in range(5)]
    rows += [(200 + i, " ".join([*words(rng, 30, wide), *([w if k != 10 + 40 * i else "edited" for k, w in enumerate(near)]), *words(rng, 50, wide)]), "en") for i in range(3)]
    rows += [(300 + i, " ".join([*words(rng, 30, wide), *short, *words(rng, 50, wide)]), "en") for i in range(4)]
    rows += [(400, rows[0][1].upper(), "en"), (500, None, "en"), (501, "", "en"), (502, "x " * 30_000, "en"), (None, rows[0][1], "en"), (1, rows[1][1], "en")]
    got = substring_dup.repeated_passages(table(spark, rows)).collect()
    linked = {frozenset((r["doc_id"], r["other_id"])) for r in got}
    assert {x for p in linked for x in p} == {0, 400, *range(100, 105), *range(200, 203)}
    assert {frozenset((100, i)) for i in range(101, 105)} <= linked
    one = next(r for r in got if {r["doc_id"], r["other_id"]} == {100, 103})["passages"][0]
    assert (one["end_word"] - one["first_word"], one["first_word"]) == (60, 33)
    assert substring_dup.repeated_passages(table(spark, rows).where("false")).collect() == []


def test_a_passage_that_begins_with_a_line_repeated_in_the_centre_is_confirmed():
    rng = np.random.default_rng(13)
    line, tail, other, apart = (rng.integers(0, 2**32, n).astype(np.uint32) for n in (36, 25, 36, 30))
    for a, b in (([line, apart, line, tail], [line, tail]), ([line, apart, other, apart[::-1], line, other], [line, other])):
        a, b = np.concatenate(a), np.concatenate(b)
        assert [(p[0], p[1], p[3], p[4]) for p in substring_dup.passages(a, b)] == [(0, len(b) + substring_dup.SHINGLE - 1, len(a) + substring_dup.SHINGLE - 1, 1.0)]


def behind_a_line(rng, wide, first, n, lower, tail, edit=False):
    """n pairs of documents that share a line of 45 words and `tail` more, each after `lower` documents with the line only."""
    rows, want = [], set()
    for k in range(n):
        line, more = words(rng, 45, wide), words(rng, tail, wide)
        ids = list(range(first + (lower + 2) * k, first + (lower + 2) * (k + 1)))
        rows += [(i, " ".join([*words(rng, 20, wide), *line, *words(rng, 20, wide)]), "en") for i in ids[:lower]]
        for i in ids[lower:]:
            part = [*line, *more]
            if edit and i == ids[-1]:
                part[rng.randrange(len(part))] = "edited"
            rows.append((i, " ".join([*words(rng, 20, wide), *part, *words(rng, 20, wide)]), "en"))
        want.add(frozenset(ids[lower:]))
    return rows, want


def beside_a_fragment(rng, wide, first, n):
    """n triples: the first shares a passage with the second and holds a part of another one that the second and third share."""
    rows, want = [], set()
    for i in range(first, first + 3 * n, 3):
        p, q = words(rng, 60, wide), words(rng, 54, wide)
        for j, parts in enumerate(([p, q[5:47]], [p, q], [q])):
            rows.append((i + j, " ".join(w for x in parts for w in [*words(rng, 20, wide), *x]) + " " + " ".join(words(rng, 20, wide)), "en"))
        want |= {frozenset((i, i + 1)), frozenset((i + 1, i + 2))}
    return rows, want


def test_passages_behind_a_frequent_line_are_linked(spark):
    rng = random.Random(14)
    rows, want = behind_a_line(rng, [f"w{i}" for i in range(20_000)], 0, 25, 30, 8)
    assert {frozenset((r["doc_id"], r["other_id"])) for r in substring_dup.repeated_passages(table(spark, rows)).collect()} == want


def test_passages_are_linked_though_another_is_shared_with_the_centre(spark):
    rng = random.Random(15)
    rows, want = beside_a_fragment(rng, [f"w{i}" for i in range(20_000)], 0, 100)
    assert {frozenset((r["doc_id"], r["other_id"])) for r in substring_dup.repeated_passages(table(spark, rows)).collect()} == want


def test_near_passages_behind_a_frequent_line_are_linked(spark):
    rng = random.Random(21)
    rows, want = behind_a_line(rng, [f"w{i}" for i in range(20_000)], 0, 60, 25, 15, edit=True)
    got = {frozenset((r["doc_id"], r["other_id"])) for r in substring_dup.repeated_passages(table(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_near_passages_at_the_threshold_are_recalled(spark):
    """Documents of several passages, with one line in all of them; each passage pair has a similarity of 0.8 to 1 by brute force."""
    rng = random.Random(22)
    wide = [f"w{i}" for i in range(30_000)]
    line = words(rng, 30, wide)
    docs, want = {i: [*words(rng, 15, wide), *line] for i in range(300)}, {}
    for k in range(200):
        p = words(rng, rng.randint(60, 160), wide)
        q = list(p)
        for at in rng.sample(range(8, len(p) - 8, 6), max(1, len(p) // 60)):
            q[at] = "edited"
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (p, q)]
        similarity = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        if similarity >= 0.8:
            a, b = rng.sample(sorted(docs), 2)
            for i, x in ((a, p), (b, q)):
                docs[i] += [*x, *words(rng, 20, wide)]
            want[frozenset((a, b))] = similarity
    got = {frozenset((r["doc_id"], r["other_id"])) for r in substring_dup.repeated_passages(table(spark, [(i, " ".join(w), "en") for i, w in docs.items()])).collect()}
    assert len(want) > 100 and len(got & set(want)) >= 0.95 * len(want) and got <= set(want)


def test_hot_keys_are_dealt_without_changing_links(spark):
    rng = random.Random(23)
    wide = [f"w{i}" for i in range(5000)]
    hot = words(rng, 80, wide)
    rows = [(i, " ".join([*words(rng, 20, wide), *hot]), "en") for i in range(1200)] + [(5000 + i, " ".join(words(rng, 90, wide)), "en") for i in range(20)]
    got = {(r["doc_id"], r["other_id"]) for r in substring_dup.repeated_passages(table(spark, rows)).collect()}
    # A few more share the word before the passage and so a key of their own.
    assert {(i, 0) for i in range(1, 1200)} <= got and len(got) < 2500 and all(i < 1200 for p in got for i in p)


def test_members_linked_to_a_centre_are_linked_to_others_too(spark):
    """Chains a, b, c: b's passage is near that of a and near that of c, and a's isn't near that of c. Nearly all keys of b and c are a's as well."""
    rng = random.Random(24)
    wide = [f"w{i}" for i in range(30_000)]
    rows, want = [], set()

    def sets(x):
        return {tuple(x[i : i + 5]) for i in range(len(x) - 4)}

    def near(x, y):
        return len(sets(x) & sets(y)) >= 0.8 * len(sets(x) | sets(y))

    for k in range(100):
        a = words(rng, 60, wide)
        b, c = list(a), list(a)
        b[22] = c[22] = f"edited{k}"
        c[42] = f"again{k}"
        assert near(a, b) and near(b, c) and not near(a, c)
        for i, x in enumerate((a, b, c)):
            rows.append((3 * k + i, " ".join([*words(rng, 20, wide), *x, *words(rng, 20, wide)]), "en"))
        want |= {frozenset((3 * k, 3 * k + 1)), frozenset((3 * k + 1, 3 * k + 2))}
    got = {frozenset((r["doc_id"], r["other_id"])) for r in substring_dup.repeated_passages(table(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_equal_texts_are_one_document_with_members(spark):
    """Ten copies each of two texts that share a passage: every copy is linked to the smallest doc_id of its text only, by all its words, and these two to each other."""
    rng = random.Random(25)
    wide = [f"w{i}" for i in range(30_000)]
    shared, short = words(rng, 60, wide), " ".join(words(rng, 49, wide))
    p, q = (" ".join([*words(rng, 20, wide), *shared, *words(rng, 20, wide)]) for _ in range(2))
    rows = [(i, p if i % 2 else q, "en") for i in range(20)] + [(30, short, "en"), (31, short, "en"), (1, p, "en"), (40, p, "en"), (40, None, "en")]
    got = sorted((r["doc_id"], r["other_id"], [tuple(x) for x in r["passages"]]) for r in substring_dup.repeated_passages(table(spark, rows)).collect())
    assert got == [(1, 0, [(20, 80, 20, 80, 1.0)])] + [(i, i % 2, [(0, 100, 0, 100, 1.0)]) for i in range(2, 20)] + [(40, 1, [(0, 100, 0, 100, 1.0)])]


def test_keys_are_split_without_changing_links(spark, monkeypatch):
    monkeypatch.setattr(substring_dup, "SMALL", 6)
    rng = random.Random(14)
    rows, want = behind_a_line(rng, [f"w{i}" for i in range(20_000)], 0, 5, 30, 8)
    assert {frozenset((r["doc_id"], r["other_id"])) for r in substring_dup.repeated_passages(table(spark, rows)).collect()} == want


@pytest.mark.parametrize("gather", [0, 20_000])
def test_keys_are_split_alike_in_one_place_and_by_joins(spark, monkeypatch, gather):
    monkeypatch.setattr(substring_dup, "SMALL", 6)
    monkeypatch.setattr(substring_dup, "GATHERED", gather)
    rng = random.Random(27)
    rows, want = behind_a_line(rng, [f"w{i}" for i in range(20_000)], 0, 4, 20, 12)
    assert {frozenset((r["doc_id"], r["other_id"])) for r in substring_dup.repeated_passages(table(spark, rows)).collect()} == want


def test_documents_with_passages_have_a_row_each(spark, tmp_path):
    """b shares p with a and q with c; d and e share r in two places of d; f shares nothing, g is a copy of e."""
    rng = random.Random(28)
    wide = [f"w{i}" for i in range(30_000)]
    p, q, r = (words(rng, 60, wide) for _ in range(3))
    texts = {1: [p], 2: [p, q], 3: [q], 4: [r, r], 5: [r], 6: []}
    rows = [(i, " ".join([w for x in parts for w in [*words(rng, 20, wide), *x]] + words(rng, 20, wide)), "en") for i, parts in texts.items()]
    rows.append((7, rows[4][1], "en"))
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["component_id"], r["n_links"], r["n_passages"], r["n_words"]) for r in substring_dup.op7_substring_dup(spark, str(tmp_path)).collect())
    assert [x[:2] for x in got] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 4)]
    assert got[:3] == [(1, 1, 1, 1, 60), (2, 1, 2, 2, 120), (3, 1, 1, 1, 60)] and got[4:] == [(5, 4, 2, 1, 100), (7, 4, 1, 1, 100)]


def test_shuffle_files_of_repeated_passages_are_deleted_as_it_goes(spark):
    rng = random.Random(26)
    rows, _ = behind_a_line(rng, [f"w{i}" for i in range(20_000)], 0, 2, 3, 10)
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return {f for d in dirs for f in Path(d).rglob("shuffle_*.data")}

    kept = spark.range(10).repartition(3)
    assert kept.count() == 10 and files()
    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    was = spark.conf.get(name)
    substring_dup.repeated_passages(table(spark, rows))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(name) == was
