import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tamarack.llm import ann, bpe, common, components, gam, jaccard, mixing, pii, quality, suffix, tokenfile, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, rid string, size string, target int, pii int, n string, kept string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta omega kappa sigma theta zeta iota rho tau").capitalize() + rng.choice(["", "", ".", ","]) + str(rng.randint(0, 40)) for _ in range(n)) + "."


TEXTS = [
    None, "", " \n\t ", "one two", "one  two", "x" * 60_000, prose(1, 200), prose(1, 200), prose(1, 200).replace("Alpha", "Omega", 1), prose(2, 30) + "\n" + prose(1, 200), prose(3, 3000),
    "Écrivez à a.b@c.org ou +1 (017) 555-7713.\n" + prose(4, 30), "<|endoftext|> naïve café ☕ 𝒳 \x85   y", prose(2, 30) + "\n" + prose(5, 40), "a b c d e f " * 40, "Home | About | Contact | Help | News\n" + prose(6, 40),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b"][i % 3], len(t or ""), 1, "r", "s", 2, 3, "n", "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[7], (None, TEXTS[6], None, None, None, None, None, None, None, None, None, None)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# --- 10 -------------------------------------------------------------------------------------------------------


def brute_quality(text):
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, nothing):
    for r in quality.judge(docs).collect():
        q, (n, *rest) = r["quality"], brute_quality(r["text"] or "")
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (n, *rest)
        assert q["base_failed"] == (n < 10 or 100 * rest[-1] > 20 * n) and not (q["base_failed"] and q["kept"])
    assert "Home |" not in "".join(t for _, t in pairs(quality.clean(docs))) and quality.clean(docs).columns == docs.columns
    assert quality.clean(nothing).count() == 0


# --- 6 --------------------------------------------------------------------------------------------------------


def test_pii(docs, nothing):
    for text, spans in (
        ("mail a@b.co, ip 1.2.3.4 card 4111 1111 1111 1111", ["email", "ip", "card"]), ("300.1.2.3 and 4111 1111 1111 1112", []), ("my bank iban DE89 3704 0044 0532 0130 00", ["iban"]),
        ("@@ a@b a@b.c@d.ef", ["email"]), ("call 555-123-4567", ["local_phone"]), ("order 555-123-4567", []),
    ):
        assert [s[0] for s in pii.find(text)] == spans, text
    redacted = dict(pairs(pii.redact(docs)))
    assert redacted[11].startswith("Écrivez à [EMAIL] ou [PHONE].") and redacted[None] == TEXTS[6]
    assert pii.scan(nothing).count() == 0 and pii.redact(docs).columns == docs.columns


@pytest.mark.parametrize("text", ["1" * 100_000, "1." * 50_000, "+1" + "(" * 100_000, "a" * 100_000 + "@", "1 " * 50_000])
def test_pii_is_linear(text):
    pii.find(text)


# --- 4 and 9 --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe(docs, real, name):
    path = public_tokenizers.path(name)
    own = Tokenizer.from_file(path)
    for frame in (docs, real):
        for r in bpe.encode(frame, path, decoded=True).collect():
            ids = own.encode(r["text"] or "", add_special_tokens=False).ids
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
            assert r["decoded"] == own.decode(ids, skip_special_tokens=False)
    back = bpe.decode(bpe.encode(docs, path), path).select("decoded").collect()
    assert len(back) == docs.count()


def test_bpe_pieces_asked_together():
    """Pieces encoded in one text have the ids that the library gives each alone, whatever characters they hold."""
    encoder = bpe.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    signs = "abcXYZ019.,'-_é\u0301\u0300İßﬁ☕𝒳日本\u200d\u00a0\u2028\x85नमस्ते<|>endoftext"
    pieces = list(dict.fromkeys("".join(rng.choice(signs) for _ in range(rng.randint(1, 12))) for _ in range(3000)))
    pieces += ["<|endoftext|>", "x<|endoftext|>y", "\u0301", "'s", "it's", "\x00"]
    assert encoder._spaced(pieces) == encoder.library(pieces)


def test_bpe_joins_are_repaired():
    codec = bpe.ChunkCodec(public_tokenizers.path("byte_bpe_50k.json"))
    one = codec.pieces.library(["hello world"])[0]
    assert codec._agrees("hello", " world", codec.pieces.library(["hello"])[0], codec.pieces.library([" world"])[0])
    assert not codec._agrees("hel", "lo world", codec.pieces.library(["hel"])[0], codec.pieces.library(["lo world"])[0]) and one


def test_token_file(spark, docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    manifest = tokenfile.write(docs, path)
    rows = tokenfile.read(spark, manifest).orderBy("start").collect()
    assert len(rows) == docs.count() and rows[0]["doc_id"] is None
    start, texts = 0, dict(pairs(docs))
    for r in rows:
        ids = np.array([*own.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += r["n_tokens"]
    file = max(manifest.collect(), key=lambda f: f["bytes"])
    fs, at = common.filesystem(file["path"])
    raw = bytearray(fs.open_input_file(at).read())
    with fs.open_input_file(at) as f:
        assert tokenfile.TokenFile(f, file["bytes"]).get(10**9) == []
    raw[len(raw) // 2] ^= 255
    import io

    with pytest.raises(Exception):  # noqa: B017, PT011
        tokenfile.TokenFile(io.BytesIO(bytes(raw)), len(raw)).frame(0)
    assert tokenfile.read(spark, tokenfile.write(nothing, path)).count() == 0


# --- 8 --------------------------------------------------------------------------------------------------------


def test_warc(spark):
    rows = [(1, "u", "<p>x</p>"), (2, "u\r\nv", "<p>x</p>"), (3, None, None), (4, "w\x00é\t%", ""), (None, "z", "é"), (5, "q", "WARC/1.1\r\n\r\nfake\x1f\u008b\x08")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("part", F.lit(1))
    got = {r["page_id"]: r for r in warc.read(spark, warc.write(pages)).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), None: ("response", None), 5: ("response", None)}
    for page, _, html in rows:
        raw = (html or "").encode()
        assert got[page]["payload_bytes"] == len(raw) and got[page]["payload_digest"] == warc.base32_sha1(raw)
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_salvage():
    members = [warc.member(warc.record(i, "u", bytes(random.Random(i).randbytes(300)), None, False)) for i in range(6)]
    bad = bytearray(members[2])
    bad[40] ^= 255
    data = b"".join([*members[:2], bytes(bad), members[3], b"junk\x1f\x8b\x08junk", members[4], warc.record(7, "p", b"plain", None, False), members[5][:-20]])
    found = list(warc.salvage(data))
    assert [x["page_id"] for x in found if isinstance(x, dict)] == [0, 1, 3, 4, 7]
    gaps = [x[:2] for x in found if not isinstance(x, dict)]
    assert gaps[0] == (len(members[0]) + len(members[1]), len(b"".join(members[:3]))) and gaps[-1][1] == len(data) and len(gaps) == 3
    assert list(warc.salvage(b"")) == []


# --- 7 --------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    """Water-filling, by repeated sharing."""
    weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), 1.5 * sum(sizes)
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / total > 2 * sizes[k]}
        for k in full or open_:
            out[k] = float(2 * sizes[k]) if full else left * weights[k] / total
        if not full:
            break
        left -= sum(out[k] for k in full)
        open_ -= full
    return out


def mix_checked(rows, shards=None):
    """Of a mix's rows: sizes and targets are right, no document is taken too often, each source comes near its target."""
    by_source = {}
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] == r["size"] * len(r["places"]) <= 2 * r["size"] and len(r["places"]) == r["copies"]
        by_source.setdefault(r["source"], []).append(r)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    goals = brute_targets([sum(r["size"] for r in by_source[s]) for s in order])
    for s, goal in zip(order, goals):
        own = by_source[s]
        assert len({r["target"] for r in own}) == 1 and own[0]["target"] == pytest.approx(goal) and {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        miss = abs(sum(r["taken"] for r in own) - goal)
        left = [r["size"] for r in own if r["size"] and r["copies"] == min(x["copies"] for x in own)]
        assert miss <= max(left) / 2, (s, miss)
        if len(own) < 2 * mixing.BLOCK_DOCS:  # one block: the smallest document left decides
            assert miss <= min(left) / 2 or goal == 2 * sum(r["size"] for r in own), (s, miss)


def test_mixing(docs, real, nothing):
    for frame in (docs, real):
        rows = mixing.mix(frame).collect()
        known = lambda rows: sorted(str((r["doc_id"], r["text"], r["source"], r["taken"], r["places"])) for r in rows)
        assert known(rows) == known(mixing.mix(frame.repartition(5)).collect())
        mix_checked(rows)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(docs).columns == docs.columns
    taken = {}
    for r in mixing.mix(real).collect():
        taken[r["doc_id"]] = r["copies"]
    got = [r["doc_id"] for r in mixing.mixed(real).collect()]
    assert {d: got.count(d) for d in taken} == taken


def test_mixing_many_documents_and_last_blocks(spark, monkeypatch):
    """More documents than blocks, and last blocks that are cut again."""
    rows = [(i, "w " * (1 + i * 7919 % 50), "abc"[i % 7 % 3] if i % 11 else None) for i in range(9000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    mix_checked(mixing.mix(frame).collect())
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 8)
    monkeypatch.setattr(mixing, "LAST", 40)
    mix_checked(mixing.mix(frame).collect())


def test_mixing_equal_rows(spark):
    """A thousand equal rows are a thousand documents."""
    frame = spark.createDataFrame([(1, "a b c", "x")] * 1000 + [(i, "d e f g", "y") for i in range(2, 400)], "doc_id long, text string, source string").repartition(6)
    rows = mixing.mix(frame).collect()
    mix_checked(rows)
    for s in "xy":
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2, s
    assert sorted(len(r["places"]) for r in rows) == sorted(len(r["places"]) for r in mixing.mix(frame.repartition(3)).collect())


def test_mixing_goes_through_the_tree(spark, monkeypatch):
    """Places are the tree's leaves: shards have even numbers of draws, of every source near its share, and what a tree
    loses is not taken."""
    frame = spark.createDataFrame([(i, "w " * (1 + i % 5), "abc"[i % 3]) for i in range(6000)], "doc_id long, text string, source string")
    leaves = []
    tree = mixing.split

    def seen(*args):
        for leaf in tree(*args):
            leaves.append(leaf)
            yield leaf

    monkeypatch.setattr(mixing, "split", seen)
    rows = mixing.mix(frame, shards=5).collect()
    quotas = sum(int(d.sum()) for _, _, d in leaves)
    assert [s for s, _, _ in leaves] == list(range(5)) and max(d.sum() for _, _, d in leaves) - min(d.sum() for _, _, d in leaves) <= 3
    in_shard = [sum(r["size"] * r["places"].count(s) for r in rows) for s in range(5)]
    assert sum(in_shard) == sum(r["taken"] for r in rows) and max(in_shard) < 1.2 * min(in_shard) and quotas > 100
    monkeypatch.setattr(mixing, "split", lambda *args: (leaf for leaf in tree(*args) if leaf[0] != 3))
    fewer = mixing.mix(frame, shards=5).collect()
    assert sum(r["taken"] for r in fewer) == pytest.approx(sum(in_shard) - in_shard[3], rel=0.05)
    monkeypatch.setattr(mixing, "split", lambda quotas, *args: iter([(0, np.arange(len(quotas)), quotas)]))
    assert {p for r in mixing.mix(frame, shards=5).collect() for p in r["places"]} == {0}


def test_salvage_inside_a_member():
    one = [warc.record(i, f"u{i}", f"page {i} ".encode() * 50, None, False) for i in range(6)]
    ids = lambda data: [x["page_id"] for x in warc.salvage(data) if isinstance(x, dict)]
    gaps = lambda data: [x[:2] for x in warc.salvage(data) if isinstance(x, tuple)]
    bad = one[2].replace(b"page 2", b"pagE 2", 1)
    member = warc.member(b"".join([*one[:2], bad, *one[3:5]]))
    data = member + warc.member(one[5])
    assert ids(data) == [0, 1, 3, 4, 5] and gaps(data) == [(0, len(member))]
    noise = [warc.record(i, None, random.Random(i).randbytes(3000), None, False) for i in range(6)]
    whole = warc.member(b"".join(noise))
    assert ids(whole[: len(whole) * 2 // 3])[:3] == [0, 1, 2] and gaps(whole[:-1]) == [(0, len(whole) - 1)] and ids(whole[:-1]) == list(range(6))
    assert ids(whole[:-8] + bytes(8) + warc.member(one[5])) == [*range(6), 5]  # the member's checksum is wrong, the records' are right
    hurt = bytearray(whole)
    hurt[len(whole) // 2] ^= 255  # what was decompressed before the fault is kept
    assert ids(bytes(hurt))[:2] == [0, 1] and set(ids(bytes(hurt))) < set(range(6))
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: version lines show in the raw bytes as well
    plain = pack.compress(b"".join(one)) + pack.flush()
    assert ids(plain[:-8]) == list(range(6))
    for number in (b"X-Page-Id: x1", b"X-Page-Id: " + b"9" * 30):
        assert ids(one[0] + one[1].replace(b"X-Page-Id: 1", number) + one[2]) == [0, 2]
    block = b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\nx"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(block)}\r\nWARC-Block-Digest: sha1:{warc.base32_sha1(block)}\r\nWARC-Payload-Digest: sha1:{warc.base32_sha1(b'x')}\r\n\r\n"
    assert ids(one[0] + head.encode() + block + b"\r\n\r\n" + one[2]) == [0, 2]


def test_salvage_reads_what_others_write():
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nhello"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 5\r\n\r\na: b\n\r\n\r\n"
    for data in (info + head + http + b"\r\n\r\n", warc.member(info) + warc.member(head + http + b"\r\n\r\n")):
        got = list(warc.salvage(data))
        assert [x["record_type"] for x in got] == ["warcinfo", "response"] and got[1]["payload"] == b"hello" and got[1]["payload_digest"] == warc.base32_sha1(b"hello")


def test_salvage_of_random_damage():
    """Bytes flipped, cut out and put in: no exception, nothing that wasn't written, and no loss beyond what was hit."""
    for seed in range(300):
        rng = random.Random(seed)
        plain = [warc.record(i, f"u{i}", rng.randbytes(rng.randint(0, 400)) + b"text " * rng.randint(0, 60), 3 if i % 4 == 1 else None, i % 4 == 1) for i in range(8)]
        wanted = {i: next(iter(warc.salvage(r))) for i, r in enumerate(plain)}
        parts, k = [], 0
        while k < 8:  # plain records, members of one record, and members of several
            n = rng.choice((1, 1, 1, 3))
            raw = b"".join(plain[k : k + n])
            parts.append((list(range(k, min(8, k + n))), raw if rng.random() < 0.3 else warc.member(raw)))
            k += n
        hit = {rng.randrange(len(parts)) for _ in range(rng.randint(0, 2))}
        data = b""
        for j, (_, raw) in enumerate(parts):
            raw = bytearray(raw)
            if j in hit:
                at = rng.randrange(len(raw))
                way = rng.randrange(3)
                if way == 0:
                    raw[at] ^= 1 << rng.randrange(8)
                elif way == 1:
                    del raw[at : at + rng.randint(1, 40)]
                else:
                    raw[at:at] = rng.choice((b"\x1f\x8b\x08", b"WARC/1.1\r\n", rng.randbytes(20)))
            data += bytes(raw)
        got = [x for x in warc.salvage(data) if isinstance(x, dict)]
        ids = [x["page_id"] for x in got]
        assert {i for j, (own, _) in enumerate(parts) if j not in hit for i in own} <= set(ids), seed
        assert all(x == wanted[x["page_id"]] for x in got if x["page_id"] is not None), seed
        gaps = [x for x in warc.salvage(data) if isinstance(x, tuple)]
        assert (gaps or not hit or len(ids) == 8) and all(0 <= a < b <= len(data) for a, b, _ in gaps)


def test_quarantine(spark, tmp_path):
    members = [warc.member(warc.record(i, "u", b"x" * 100, None, False)) for i in range(3)]
    (tmp_path / "a.warc.gz").write_bytes(members[0] + b"junk" * 5 + members[1])
    (tmp_path / "b.warc.gz").write_bytes(members[2])
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",), (f"file://{tmp_path}/b.warc.gz",)], "path string")
    assert [(r["path"][-9:], r["start"], r["end"]) for r in warc.quarantine(spark, manifest).collect()] == [("a.warc.gz", len(members[0]), len(members[0]) + 20)]
    assert sorted(r["page_id"] for r in warc.read(spark, manifest).collect()) == [0, 1, 2]


def test_warc_hot_payload(spark, monkeypatch):
    """Digests above the bound meet their keeper by broadcast; the result is the same."""
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise((F.col("id") % 50).cast("string")).alias("html"))
    monkeypatch.setattr(warc, "HOT_DIGESTS", 20)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read(spark, warc.write(pages)).collect()}
    text = lambda i: "same" if i % 3 else str(i % 50)
    last = {text(i): i for i in range(300)}
    assert got == {i: ("response", None) if last[text(i)] == i else ("revisit", last[text(i)]) for i in range(300)}


def test_targets_and_split():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([], []) == [] and mixing.targets([0, 10], [3, 1]) == [0, 15]
    quotas = np.array([50, 7, 0, 20])
    leaves = list(mixing.split(quotas, 7, np.random.default_rng(1)))
    total = np.zeros(4, int)
    for _, sources, draws in leaves:
        total[sources] += draws
    sums = [d.sum() for _, _, d in leaves]
    assert [s for s, _, _ in leaves] == list(range(7)) and (total == quotas).all() and max(sums) - min(sums) <= 2
    assert list(mixing.split(np.zeros(3, int), 4, np.random.default_rng(1))) == []
    assert mixing.nearest(np.array([5, 3, 9, 0]), 8.0).tolist() == [True, True, False, False] and mixing.nearest(np.array([9]), 5.0).tolist() == [True] and not mixing.nearest(np.array([9]), 4.0).any()


# --- 5 --------------------------------------------------------------------------------------------------------


def brute_components(items):
    sets = []
    for _, t in items:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(items)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            common_ = len(sets[i] & sets[j])
            if common_ and 100 * common_ >= 75 * (len(sets[i]) + len(sets[j]) - common_):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(items):
        known = [x for x in (least.get(top(i)), d) if x is not None]
        least[top(i)] = min(known, default=None)
    return sorted(((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(items)), key=str)


def test_jaccard(spark, docs, real, nothing):
    near = [(i, " ".join(w if random.Random(100 * i + k).random() > 0.02 else "edit" for k, w in enumerate(prose(9, 120).split()))) for i in range(60)]
    family = spark.createDataFrame(near, "doc_id long, text string")
    for frame in (docs, real, family):
        got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.labelled(jaccard.join(frame)).collect()), key=str)
        assert got == brute_components(pairs(frame))
    kept = jaccard.dedupe(docs)
    assert kept.columns == docs.columns and {6, 7, 8} & {r["doc_id"] for r in kept.collect()} == {6}
    assert jaccard.labelled(jaccard.join(nothing)).count() == 0


def brute_links(items):
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for _, t in items]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= 75 * len(a | b)
    return sets, {(i, j) for j in range(len(items)) for i in range(j) if linked(sets[i], sets[j])}


def test_jaccard_links(spark, docs, real, nothing, monkeypatch):
    near = [(i, " ".join(w if random.Random(100 * i + k).random() > 0.02 else "edit" for k, w in enumerate(prose(9, 120).split()))) for i in range(60)]
    family = spark.createDataFrame([*near, near[0]], "doc_id long, text string")
    for block in (jaccard.BLOCK, 7):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        for frame in (docs, real, family) if block > 7 else (family,):
            found, items = jaccard.join(frame), pairs(frame)
            sets, links = brute_links(items)
            ends = [x for link in links for x in link]
            assert sorted(((r["doc_id"], r["n_links"]) for r in jaccard.linked(found).collect()), key=str) == sorted(((d, ends.count(i)) for i, (d, _) in enumerate(items)), key=str)
            different = {frozenset((frozenset(sets[i]), frozenset(sets[j]))) for i, j in links if sets[i] != sets[j]}
            assert found.links.count() == found.links.distinct().count() == len(different)
            assert found.classes.agg(F.sum("n_links")).first()[0] == 2 * len(different)
            rows = lambda x: sorted((tuple(r) for r in jaccard.labelled(x).drop("rid").collect()), key=str)
            assert rows(jaccard.connect(frame)) == rows(found)
    assert jaccard.linked(jaccard.join(nothing)).count() == 0


def test_jaccard_families_that_nearly_link(spark, monkeypatch):
    """Pages of a template, a fifth of each its own: none link, and no pairs are made. Beside them some that do."""
    template = prose(3, 400).split()
    rows = [(i, " ".join(template + [f"own{i}x{k}" for k in range(90)])) for i in range(3000)]
    rows += [(5000 + i, " ".join(template + [f"own{i}x{k}" for k in range(88)] + ["and", f"more{i}"])) for i in range(20)]
    verified, seen = jaccard._verified, []

    def counted(pairs, index):
        seen.append(pairs.count())
        return verified(pairs, index)

    monkeypatch.setattr(jaccard, "_verified", counted)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for found in (jaccard.join(frame), jaccard.connect(frame)):
        parts = {r["doc_id"]: r["component_id"] for r in jaccard.labelled(found).collect()}
        assert {d: c for d, c in parts.items() if d != c} == {5000 + i: i for i in range(20)}
    assert sum(seen) < 20_000


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components.components(links).collect()} == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


def test_components_settle(spark, monkeypatch):
    monkeypatch.setattr(components, "ROUNDS", 1, raising=False)  # no number of rounds ends the work early
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components.components(links).collect()} == {(i, 0) for i in range(41)}


# --- 3 --------------------------------------------------------------------------------------------------------


def brute_suffix(items):
    first = {}
    for d, t in items:
        b = t.encode()
        for p in range(len(b) - 49) if d is not None else ():
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], d), d)
    out = []
    for d, t in items:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49) if d is not None else ():
            if first[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        out.append((d, len(b), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b))), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_suffix(docs, real, nothing):
    for frame in (docs, real):
        got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.remove(frame).collect()), key=str)
        assert got == brute_suffix(pairs(frame))
    assert set(docs.columns) <= set(suffix.remove(docs).columns) and suffix.remove(nothing).count() == 0


def test_suffix_hot_anchors(spark, docs, real, monkeypatch):
    """Anchors of many rows go by windows; the result is the same."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = [letters(30), letters(45), letters(60)]
    rows = [(i, letters(rng.randint(0, 90)) + rng.choice(shared) + letters(rng.randint(0, 90)) + rng.choice(shared)) for i in range(120)]
    family = spark.createDataFrame([*rows, rows[5], rows[6]], "doc_id long, text string").repartition(5)
    for hot in (2, 20):
        monkeypatch.setattr(suffix, "HOT_ROWS", hot)
        for frame in (docs, real, family):
            got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.remove(frame).collect()), key=str)
            assert got == brute_suffix(pairs(frame))


def test_suffix_one_anchor_in_many_surroundings():
    """Near-linear in the pieces of one anchor."""
    import time

    rng = np.random.default_rng(4)
    seconds = {}
    for n in (8_000, 32_000):
        data = rng.integers(97, 123, n * 76, dtype=np.uint8).reshape(n, 76)
        data[:, 26:50] = np.frombuffer(b"the shared anchor bytes!", np.uint8)
        data[n // 2 :: 9] = data[: len(data[n // 2 :: 9])]
        begun = time.perf_counter()
        piece, lo, hi = suffix.duplicated(data.ravel(), np.arange(n) * 76, np.full(n, 76), np.full(n, 26), np.arange(n))
        seconds[n] = time.perf_counter() - begun
        assert sorted(piece.tolist()) == list(range(n // 2, n, 9)) and (lo == 0).all() and (hi == 76).all()
    assert seconds[32_000] < 2


def test_suffix_short_periods(spark, monkeypatch):
    """A piece that texts repeat within themselves is sent once a flush: no bucket gets more bytes than it sorts at once."""
    sort = suffix.duplicated

    def bounded(data, *rest):
        assert len(data) <= 2 << 20
        return sort(data, *rest)

    monkeypatch.setattr(suffix, "duplicated", bounded)
    rows = [(3, "abhtm " + "gtm " * 40_000 + "end"), (1, "gtm " * 60_000 + "x" + "the " * 10_000), (2, "a" * 30_000), (4, "b" + "a" * 20_000 + "the " * 9_000), (3, "gtm " * 30_000 + "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.remove(frame).collect()), key=str)
    assert got == brute_suffix(rows)


def test_suffix_twins_and_rounds(spark, docs, real, monkeypatch):
    """Repeats within a text, flushes and sorts of a few bytes, windows in rounds: the result is the same."""
    rng = random.Random(11)
    words = ["the shared phrase of thirty bytes ", "gtm ", "a", "other words between them ", "en theaeaen the "]
    rows = [(rng.randrange(40), "".join(rng.choice(words) * rng.choice((1, 1, 2, 30)) + rng.choice(("", "xyz"[rng.randrange(3) :])) for _ in range(rng.randint(1, 9)))) for _ in range(60)]
    family = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for sorted_, flushed, hot in ((300, 2_000, 20_000), (1_000, 1 << 20, 20_000), (300, 5_000, 3)):
        monkeypatch.setattr(suffix, "SORT_BYTES", sorted_)
        monkeypatch.setattr(suffix, "FLUSH_BYTES", flushed)
        monkeypatch.setattr(suffix, "HOT_ROWS", hot)
        for frame in (family, docs, real) if hot == 3 else (family,):
            got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.remove(frame).collect()), key=str)
            assert got == brute_suffix(pairs(frame))


@pytest.mark.parametrize("collide", [False, True])
def test_suffix_windows_by_hash(monkeypatch, collide):
    """Pieces of one anchor beyond SORT_BYTES give what sorting them at once gives, also where hashes collide."""
    rng = np.random.default_rng(5)
    n = 400
    data = rng.integers(97, 99, n * 76, dtype=np.uint8).reshape(n, 76)
    data[:, 6:70] = data[0, 6:70]
    data[::3, 30:32] = 122
    start, length, doc = np.arange(n) * 76, np.full(n, 76), rng.integers(0, 90, n)
    covered = lambda found: {(p, k) for p, a, b in found for k in range(a, b)}
    whole = covered(zip(*(x.tolist() for x in suffix.duplicated(data.ravel(), start, length, np.full(n, 40), doc))))
    monkeypatch.setattr(suffix, "SORT_BYTES", 2_000)
    if collide:
        monkeypatch.setattr(suffix, "mix64", lambda x: x % np.uint64(50))
    assert whole and whole == covered(t for x in suffix.by_windows(data.ravel(), start, length, doc) for t in zip(*(y.tolist() for y in x)))
    if not collide:
        assert whole == covered(t for x in suffix.repeats(data.ravel(), start, length, np.full(n, 40), doc) for t in zip(*(y.tolist() for y in x)))


def test_suffix_sort():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)), np.uint8)
    starts = np.arange(2900)
    group = np.sort(np.array([rng.randrange(40) for _ in starts]))
    order = suffix.Suffixes(data, common.PrefixHash(data)).sort(starts, group)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(len(starts)), key=lambda i: (group[i], raw[starts[i] : starts[i] + 50], i))


# --- 1 and 2 --------------------------------------------------------------------------------------------------


def test_gam(spark, docs, real, nothing):
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    every = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    model = gam.train(every, labels)
    rows = gam.score(every, model).select("doc_id", "score", gam.held_out().alias("h")).join(labels, "doc_id").where("h and quality is not null").collect()
    assert sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in rows) / len(rows) >= 0.9 and model.pairs
    assert all(0 <= r["score"] <= 1 for r in gam.score(docs, model).collect()) and gam.score(nothing, model).count() == 0
    empty = gam.train(every, labels.limit(0))
    assert {r["score"] for r in gam.score(docs, empty).collect()} == {0.5}
    assert gam.train(docs, labels.withColumn("quality", F.lit(1))).tables


def test_ann(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    ids, vectors = zip(*((r["vec_id"], np.array(r["embedding"], float)) for r in table.orderBy("vec_id").collect()))
    ids, unit = np.array(ids), np.stack(vectors)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = total = 0
    got = {}
    for r in ann.neighbours(table).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in ids[ids % 50 == 0]:
        score = unit @ unit[np.searchsorted(ids, q)]
        best = [i for i in ids[np.argsort(-score, kind="stable")] if i != q][:5]
        hits, total = hits + len(set(best) & {v for v, _ in got[q].values()}), total + 5
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
    assert hits / total >= 0.9


@pytest.mark.parametrize("width, parts", [(32, 60), (64, 0), (101, 300)])
def test_ann_recall(width, parts):
    """In one slab of 20,000 vectors, clustered or not, with few of them reranked: 13 of 1,000."""
    rng = np.random.default_rng(width)
    x = rng.standard_normal((20_000, width))
    if parts:
        x = 0.7 * x + 2 * rng.standard_normal((parts, width))[rng.integers(0, parts, len(x))]
        x[10_000:10_400] = x[:400] + 0.05 * rng.standard_normal((400, width))
    x *= np.exp(rng.standard_normal((len(x), 1)))
    ids = np.arange(len(x))
    chosen = ids[::50]
    books = ann.Codebooks(x[rng.permutation(len(x))[: 6_000]])
    query, found, score = ann.best(ids, x, ann.packed(books.encode(x)), chosen, x[chosen], books, 5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = unit[chosen] @ unit.T
    exact[np.arange(len(chosen)), chosen] = -2
    want = np.argsort(-exact, axis=1, kind="stable")[:, :5]
    hits = sum(len(set(found[query == q]) & set(w)) for q, w in zip(chosen, want))
    assert hits / want.size >= 0.9
    assert score == pytest.approx((unit[query] * unit[found]).sum(1), abs=1e-12)


def test_ann_extreme_lengths(spark):
    """Squares of these components are no doubles; their cosines are."""
    rows = [(0, [3e200, 4e200]), (1, [3e-200, 4e-200]), (2, [4e-320, 3e-320]), (3, [1.7e308, -1.7e308]), (4, [0.0, 5e-324])]
    got = {r["vec_id"]: r["score"] for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: pytest.approx(1.0), 2: pytest.approx(0.96, abs=1e-4), 3: pytest.approx(-0.1414213562), 4: pytest.approx(0.8)}


def test_ann_cases(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [1.0, None, 0.0]), (8, [1.0]), (None, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("codes", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.neighbours(frame).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (0, 4, 9, 0.0)]
    assert ann.neighbours(frame.limit(0)).count() == 0


# --- pipeline -------------------------------------------------------------------------------------------------


def test_pipeline(spark, real):
    import corpus_pipeline

    frame = real
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, frame = frame, common.stored(stage(spark, frame, SF), "test-pipeline")
        if k < 4:
            assert frame.columns == real.columns and 0 < frame.count() <= 2 * before.count()
    assert {"doc_id", "ids", "n_tokens", "decoded"} <= set(frame.columns)
    assert not [t for _, t in pairs(frame) if any(s[4] for s in pii.find(t))]
