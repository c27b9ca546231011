"""Every registered query, on whole tables, against plain versions; the pipeline stage by stage; columns of any name."""

import hashlib
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm import SF, TEXTS, WORD, brute_components, brute_quality, brute_suffix, mix_checked
from tokenizers import Tokenizer

from tamarack.llm import bpe, common, gam, jaccard, mixing, pii, quality, queries, suffix, tokenfile, warc


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(real):
    return {r["doc_id"]: r["text"] or "" for r in real.collect()}


def rows_of(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# --- queries --------------------------------------------------------------------------------------------------


def test_op1(spark, real, texts):
    frame = queries.op1_quality(spark, SF)
    got = rows_of(frame)
    assert frame.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")] and set(got) == set(texts)
    model = gam.train(real, spark.read.parquet(f"{SF}/labels.parquet"))
    import pyarrow as pa

    for d, t in texts.items():
        x = gam.features(pa.array([t]))[0]
        bins = [int(sum(v >= e for e in edges)) for v, edges in zip(x, model.edges)]
        total = model.intercept + sum(table[b] for table, b in zip(model.tables, bins)) + sum(table[bins[i], bins[j]] for (i, j), table in zip(model.pairs, model.pair_tables))
        assert got[d]["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9) and got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert got[d]["predicted"] == int(got[d]["score"] >= 0.7)


def test_op1_is_repeatable(spark):
    """The same rows in any order give the same model, also when there are more than are learned from."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    models = [gam.train(d, x, rows=100) for d, x in ((docs, labels), (docs.repartition(7), labels.repartition(5)), (docs.orderBy(F.desc("doc_id")), labels.orderBy("doc_id")))]
    for m in models[1:]:
        assert m.intercept == models[0].intercept and all((a == b).all() for a, b in zip(m.tables, models[0].tables)) and m.pairs == models[0].pairs
    doubled = gam.train(docs.union(docs), labels, rows=100)
    assert doubled.tables and len(doubled.edges) == len(gam.FEATURES)


def test_op2(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    frame = queries.op2_ann(spark, SF)
    got = frame.collect()
    assert frame.dtypes[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert {(r["query_id"], r["rank"]) for r in got} == {(int(q), k) for q in ids if q % 50 == 0 for k in range(1, 6)}
    for r in got:
        assert r["score"] == pytest.approx(float(unit[ids == r["query_id"]][0] @ unit[ids == r["vec_id"]][0]), abs=1e-12) and r["query_id"] != r["vec_id"]


def test_op3(spark, texts):
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op3_suffix_dedup(spark, SF).collect()), key=str)
    assert got == brute_suffix(list(texts.items()))


def test_op4(spark, texts):
    own, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), rows_of(queries.op4_bpe(spark, SF))
    for d, t in texts.items():
        ids = own.encode(t, add_special_tokens=False).ids
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(own.decode(ids, skip_special_tokens=False)))


def test_op5(spark, texts):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op5_jaccard(spark, SF).collect()), key=str)
    assert got == brute_components(list(texts.items()))


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and plain_luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def plain_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_base(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, pattern, passes) in enumerate(BASE) for m in re.finditer(pattern, text) if passes(m[0])]
    return [(kind, s, e) for s, _, kind, e in sorted(found)]


def test_op6(spark, texts):
    got = rows_of(queries.op6_pii(spark, SF))
    for d, t in texts.items():
        base = plain_base(t)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert tuple(got[d][f"n_{k}"] for k, *_ in BASE) == tuple(sum(x[0] == k for x in base) for k, *_ in BASE) and got[d]["base_sha256"] == sha(listed)
        assert set(listed.split(",")) - {""} <= set(got[d]["spans"].split(","))


def test_pii_base_on_random_texts():
    import random

    for seed in range(4000):
        rng = random.Random(seed)
        text = "".join(rng.choice(["a", "Z", "@", ".", ".", "-", "+", " ", "(", ")", "0", "1", "2", "5", "25", "255", "256", "4111 1111 1111 1111", "4", "7", "%", "é", "\n"]) for _ in range(rng.randint(0, 60)))
        assert [(k, s, e) for k, s, e, _, base in pii.find(text) if base] == plain_base(text), text


@pytest.mark.parametrize("text, kinds", [("hotel 555-123-4567", []), ("tel 555-123-4567", ["local_phone"]), ("Tel. 555-123-4567", ["local_phone"]), ("basically 555-123-4567", []), ("recall: 555-123-4567", []), ("reorder, call 555-123-4567", ["local_phone"])])
def test_pii_context_is_whole_words(text, kinds):
    assert [s[0] for s in pii.find(text)] == kinds


def test_op7(spark, real, texts):
    sources = {r["doc_id"]: r["source"] for r in real.select("doc_id", "source").collect()}
    rows = [r.asDict() | {"text": texts[r["doc_id"]], "source": sources[r["doc_id"]], "copies": len(r["places"])} for r in queries.op7_mixing(spark, SF).collect()]
    assert len(rows) == len(texts)
    mix_checked(rows)


def test_op9(spark, texts):
    own, got, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), rows_of(queries.op9_token_file(spark, SF)), 0
    for d in sorted(texts):
        ids = np.array([*own.encode(texts[d], add_special_tokens=False).ids, 0], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_file_reads_one_frame(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME_BYTES", 400)
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"text number {i} " * 12) for i in range(60)], "doc_id long, text string").coalesce(1)
    file = max(tokenfile.write(docs, path).collect(), key=lambda f: f["docs"])
    fs, at = common.filesystem(file["path"])
    with fs.open_input_file(at) as f:
        held, seen = tokenfile.TokenFile(f, file["bytes"]), []
        frame = held.frame
        held.frame = lambda k: seen.append(k) or frame(k)
        wanted = file["first_doc"] + 7
        ids = held.get(wanted)
        assert len(held.index) > 5 and len(seen) == 1 and ids[0].tolist() == [*Tokenizer.from_file(path).encode(f"text number {wanted} " * 12, add_special_tokens=False).ids, 0]


BOILERPLATE = "cookie policy|privacy policy|terms of use|terms of service|all rights reserved|enable javascript|skip to content|skip to main content|accept cookies|accept all cookies|click here|back to top|subscribe to our|lorem ipsum"


def plain_kept(text):
    """(kept, the lines that stay)."""
    n, *_, repeated = brute_quality(text)
    had = left = 0
    stay = []
    for line in text.split("\n"):
        words = WORD.findall(line)
        if not words:
            stay.append(line)
            continue
        bars, shouts = sum(w in "|»>•·" for w in words), len(re.findall("[!?]{2,}", line))
        fails = (bars >= 2 and 100 * bars >= 20 * len(words)) or 100 * sum(c in "#*$%&|<>" for c in line) >= 12 * len(line) or (shouts >= 2 and 100 * shouts >= 30 * len(words))
        fails |= (len(words) >= 12 and not re.search("[.!?…:;。！？]", line)) or (len(words) <= 20 and re.search(BOILERPLATE, line, re.I) is not None)
        had += len(line)
        if not fails:
            left += len(line)
            stay.append(line)
    return not (n < 10 or 100 * repeated > 20 * n) and 100 * (had - left) <= 50 * had, "\n".join(stay)


def test_op10(spark, texts):
    got = rows_of(queries.op10_quality_rules(spark, SF))
    for d, t in texts.items():
        n, *rest = brute_quality(t)
        assert [got[d][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [n, *rest]
        assert got[d]["base_failed"] == (n < 10 or 100 * rest[-1] > 20 * n) and got[d]["kept"] == plain_kept(t)[0]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    told = con.execute(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(told.columns)]
    plain = lambda df: sorted(tuple(None if v is None or v != v else v for v in r) for r in df.astype(object).values.tolist())
    assert [tuple(map(str, r)) for r in plain(got.astype(object).where(got.notna(), None))] == [tuple(map(str, r)) for r in plain(told.astype(object).where(told.notna(), None))] or len(got) == len(told) and plain(got) == plain(told)


# --- pipeline -------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, real, texts):
    """What each stage gives is what a plain version makes of its input."""
    stages = [f for _, f in corpus_pipeline.STAGES]
    step = lambda k, docs: common.stored(stages[k](spark, docs, SF), "test-stage")
    plain = {r["doc_id"]: r for r in real.collect()}

    docs = step(0, real)
    cleaned = {d: t for d, (kept, t) in ((d, plain_kept(t)) for d, t in texts.items()) if kept}
    rows = docs.collect()
    assert {r["doc_id"]: r["text"] for r in rows} == cleaned and docs.columns == real.columns
    assert all((r["source"], r["lang"], r["n_chars"]) == (plain[r["doc_id"]]["source"], plain[r["doc_id"]]["lang"], len(r["text"])) for r in rows)

    docs = step(1, docs)
    kept = {c for _, _, c in brute_components(list(cleaned.items()))}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {d: cleaned[d] for d in kept}

    docs = step(2, docs)
    masked = {}
    for d in kept:
        spans = pii.find(cleaned[d])
        covered = [False] * len(cleaned[d])
        for _, s, e, *_ in spans:
            covered[s:e] = [True] * (e - s)
        assert {(k, s, e) for k, s, e, _, base in spans if base} == set(plain_base(cleaned[d]))
        masked[d] = (re.sub(r"\[(EMAIL|IP|CARD|PHONE|IBAN|LOCAL_PHONE)\]", "", cleaned[d]), "".join(c for c, x in zip(cleaned[d], covered) if not x), len(spans))
    for r in docs.collect():
        whole, rest, n = masked[r["doc_id"]]
        assert re.sub(r"\[(EMAIL|IP|CARD|PHONE|IBAN|LOCAL_PHONE)\]", "", r["text"]) == (rest if n else whole) and r["n_chars"] == len(r["text"])
    redacted = {r["doc_id"]: r["text"] for r in docs.collect()}

    mix = mixing.mix(docs).collect()
    mix_checked(mix)
    copies = {r["doc_id"]: r["copies"] for r in mix}
    docs = step(3, docs)
    rows = docs.collect()
    ids = [r["doc_id"] for r in rows]
    assert {d: ids.count(d) for d in copies} == copies and all(r["text"] == redacted[r["doc_id"]] for r in rows) and docs.columns == real.columns

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    final = step(4, docs).collect()
    assert sorted(r["doc_id"] for r in final) == sorted(ids)
    for r in final:
        told = own.encode(r["text"], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == told and r["n_tokens"] == len(told) and r["decoded"] == own.decode(told, skip_special_tokens=False)


# --- columns of any name --------------------------------------------------------------------------------------

NAMES = ["_row", "_clean", "clean", "_bpe", "_doc", "_source", "_text", "_null", "rid", "part", "class", "rank", "id", "block", "cut", "copy", "shard", "size", "target", "copies", "places", "n", "token", "level", "root", "a", "b", "a.b", "c`d", "score", "pii", "quality", "kept", "n_bytes", "ids", "decoded"]
OPERATORS = {
    "gam": (lambda d: gam.score(d, gam.Model([np.zeros(0)] * len(gam.FEATURES))), {"score"}), "suffix": (suffix.remove, {"n_bytes", "kept", "n_removed", "n_spans"}), "bpe": (lambda d: bpe.encode(d, public_tokenizers.path("byte_bpe_50k.json"), decoded=True), {"ids", "decoded", "n_tokens"}),
    "jaccard": (jaccard.dedupe, set()), "pii": (pii.redact, set()), "pii spans": (pii.scan, {"pii"}), "mix": (mixing.mix, {"size", "target", "copies", "places", "source_size", "taken"}), "mixed": (mixing.mixed, set()),
    "judge": (quality.judge, {"quality"}), "clean": (quality.clean, set()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name(spark, name):
    """Result columns replace those of their names; all others come through, whatever they are called."""
    run, made = OPERATORS[name]
    quoted = ", ".join(f"`{c.replace('`', '``')}` string" for c in NAMES)
    rows = [(i, TEXTS[k], "s", *[f"{c}{i}" for c in NAMES]) for i, k in enumerate((6, 8, 10, 11, 0, 15))]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, source string, {quoted}")
    got = run(frame)
    assert len(got.columns) == len(set(got.columns)) and set(frame.columns) <= set(got.columns)
    back = got.collect()
    assert back
    for r in back:
        for c in set(NAMES) - made:
            assert r[c] == f"{c}{r['doc_id']}", c
        assert all(r[c] != f"{c}{r['doc_id']}" for c in made & set(NAMES))


def test_clear(spark):
    path = common.scratch(spark, "test")
    spark.range(3).write.parquet(path)
    assert common.clear(spark) >= 1
    fs, at = common.filesystem(path)
    assert fs.get_file_info(at).type.name == "NotFound"


def test_warc_tables_read_back(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in warc.read(spark, warc.write(pages)).collect()}
    for r in pages.collect():
        found = got[r["page_id"]]
        raw = (r["html"] or "").encode()
        assert found["payload_digest"] == warc.base32_sha1(raw) and (found["payload"] == raw if found["record_type"] == "response" else found["payload"] is None)
