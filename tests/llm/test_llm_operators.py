"""The training-data operators against brute force, exact round trips and held-out labels, and their edge cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmeter.llm import media, mixing, neardup, packing, phrases, pii, queries, secrets, spans, toxicity, vectors, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \t\n", "one", "a b c", "x" * 5000, "a b c", "word " * 3000, "é ü   \x85 \U0001f600", "Same text here for all of us today", "Same text here for all of us today"]


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(n))


# packing


def test_plan_keeps_every_capacity_and_places_all():
    rnd = random.Random(1)
    for capacity in (packing.Capacity(), packing.Capacity(64, 5, 20, 16), packing.Capacity(documents=40), packing.Capacity(attention=30)):
        counts = {}
        for _ in range(800):
            n = rnd.randrange(1, 51)
            counts[n] = counts.get(n, 0) + 1
        for score in ("norm", "dot"):
            bins, seen = {}, {n: 0 for n in counts}
            for length, first, last, each, bin_, at in packing.plan_packing(counts, capacity, score=score):
                assert first == seen[length]
                seen[length] = last
                for k in range(first, last):
                    bins.setdefault(bin_ + (k - first) // each, []).append((at + (k - first) % each * length, length))
            assert seen == counts
            for items in bins.values():
                items.sort()
                assert [o for o, _ in items] == [sum(n for _, n in items[:i]) for i in range(len(items))]
                assert sum(n for _, n in items) <= capacity.tokens and len(items) <= capacity.documents and sum(-(-n // capacity.tile) ** 2 for _, n in items) <= capacity.attention


def test_every_capacity_binds():
    counts = {1: 5000, 20: 600, 300: 40, 2048: 3}
    bins = lambda **how: max(b + (last - first - 1) // each for _, first, last, each, b, _ in packing.plan_packing(counts, packing.Capacity(**how))) + 1
    loose = bins(documents=10**6, attention=10**6)
    assert bins(documents=128, attention=10**6) > loose and bins(documents=10**6, attention=256) > loose


def plain_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids


def test_packing_covers_whole_texts_gaplessly(spark):
    texts = [*ODD, "token " * 9000, "a<|endoftext|>b", "<|endoftext|>", "é<|endoftext|> <|endoftext"]
    docs = docs_of(spark, texts)
    rows = [r.asDict() for r in packing.pack_documents(docs).collect()]
    for i, t in enumerate(texts):
        ids = np.array([*plain_ids(t), 0], "<u4")
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(ids)
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            assert r["length"] == 2048 or r["piece"] == 0
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert all(o == sum(n for _, n in p[:i]) for i, (o, _) in enumerate(p)) and sum(n for _, n in p) <= 2048
    assert len(places) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_both_tokenizer_libraries_agree(spark):
    both = packing.public_tokenizer()
    for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert both.ids(t) == both.whole.encode(t, add_special_tokens=False).ids


# media


def test_media_round_trip_and_damage():
    rnd = random.Random(2)
    for n in (0, 1, 64, 1416, 1417, 1418, 5000, 100_000):
        payload = bytes(rnd.randrange(256) for _ in range(n))
        stream = media.write_mpeg(payload)
        found = media.read_mpeg(stream)
        assert media.stored_payload(stream, found) == payload and found["crc_bad"] == 0 and found["skipped"] == 0
        assert found["vbr"]["frames"] == len(found["offsets"]) and len(found["vbr"]["toc"]) == 100
        assert found["seconds"] == Fraction(1152 * len(found["offsets"]), 32000)
    stream = media.write_mpeg(b"text" * 3000)
    clean = media.read_mpeg(stream)
    at = clean["offsets"][3]
    broken = media.read_mpeg(stream[:at] + b"noise\xff\xfb" + stream[at:])
    assert broken["skipped"] == 7 and len(broken["offsets"]) == len(clean["offsets"])
    flipped = bytearray(stream)
    flipped[at + 8] ^= 1
    assert media.read_mpeg(bytes(flipped))["crc_bad"] == 1
    assert media.read_mpeg(None)["seconds"] == 0 and media.read_mpeg(b"\xff" * 50)["offsets"] == []
    tag = b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    tagged = media.read_mpeg(stream + tag)
    assert tagged["tags"]["TIT2"] == "Title" and tagged["skipped"] == 0 and tagged["offsets"] == clean["offsets"]
    noisy = media.read_mpeg(stream + b"noise" + tag)
    assert noisy["tags"]["TIT2"] == "Title" and noisy["skipped"] == 5


def test_marks_of_formats_in_payloads_lose_nothing():
    for mark in (b"TAG", b"ID3", b"Xing", b"VBRI", b"\xff\xfa\x18\xc0", b"\xff"):
        for size in (64, 128, 192, 1408, 1472):
            for at in {*range(0, 64), *range(size - 140, size)} & {*range(size)}:
                payload = (b"x" * at + mark).ljust(size, b"y")[:size]
                stream = media.write_mpeg(payload)
                assert media.stored_payload(stream, media.read_mpeg(stream)) == payload, (mark, size, at)


def test_media_query(spark):
    docs = docs_of(spark, ODD)
    rows = {r["doc_id"]: r for r in media.read_media(media.text_media(docs)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert rows[4]["media_sha256"] == rows[6]["media_sha256"]
    for r in rows.values():
        assert len(r["seek"]) == r["frames"] and (r["seconds_num"], r["seconds_den"]) == ((x := Fraction(1152 * r["frames"], 32000)).numerator, x.denominator)


def test_registered_queries_keep_their_contracts(spark, tmp_path):
    """op2, op1 and op6 as registered, over tables of odd rows, against plain Python."""
    texts = [*ODD, "x" * 29 + "TAG" + "y" * 60, "a<|endoftext|>b"]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in queries.op2_mpeg_media(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        whole = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["payload_sha256"], rows[i]["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert rows[i]["media_bytes"] == len(media.write_mpeg(whole)) and f"frames={rows[i]['frames']};" in rows[i]["feature"] and rows[i]["seek"][-1] < rows[i]["media_bytes"]
    pieces = queries.op1_best_fit_packing(spark, str(tmp_path)).collect()
    for i, t in enumerate(texts):
        ids = np.array([*plain_ids(t), 0], "<u4")
        mine = sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine] and sum(r["length"] for r in mine) == len(ids)
    html = ["<p>a</p>", None, "", "<p>a</p>", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "", "é" * 4000]
    spark.createDataFrame([(9 - i, f"http://h.example/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in queries.op6_warc_transactions(spark, str(tmp_path)).collect()}
    payloads = {9 - i: (h or "").encode() for i, h in enumerate(html)}
    for page, payload in payloads.items():
        first = min(p for p, x in payloads.items() if x == payload)
        r = got[page]
        import base64

        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page == first else ("revisit", first))


# vectors


def brute_vectors(vecs, least=0.95):
    n = len(vecs)
    x = [np.array(v, float) if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) else None for _, v in vecs]
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= least:
                links[i].add(j)
    return links


def test_vectors_match_brute_force_and_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 64))
    vecs = [(i, [float(c) for c in base[i % 60] + rng.normal(size=64) * (0.05 if i % 3 else 0.35)]) for i in range(400)]
    vecs += [(1000 + i, vecs[7][1]) for i in range(30)]
    vecs += [(2000, None), (2001, [0.0] * 64), (2002, [float("nan")] + [1.0] * 63), (2003, [None] + [1.0] * 63), (2004, [])]
    want = brute_vectors(vecs)
    df = spark.createDataFrame([(i, v, 0) for i, v in vecs], "vec_id long, embedding array<float>, label int")
    stored = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute_vectors(stored)
    got = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    assert len(got) == len(vecs)
    found, true = sum(r["n_links"] for r in got.values()), sum(map(len, want))
    assert true * 0.97 <= found <= true
    for (i, _), links in zip(stored, want, strict=True):
        assert got[i]["n_links"] <= len(links)
        if not links:
            assert got[i]["component_id"] == i and got[i]["kept"]
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_long_lists_split_by_two_pivots_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 32))
    df = spark.createDataFrame([(i, [float(c) for c in base[i % 3] + rng.normal(size=32) * 0.12]) for i in range(120)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, vectors.near_vectors(df, pivots=16).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 3)
    assert sorted(map(tuple, vectors.near_vectors(df, pivots=16).collect())) == whole and sum(r[1] for r in whole) > 2_000


def test_vectors_of_any_size_link(spark):
    v = [1.0, 2.0, -3.0, 0.5]
    rows = [(1, v), (2, [x * 1e200 for x in v]), (3, [x * 1e-200 for x in v]), (4, [-x * 1e-300 for x in v]), (5, [float("inf")] * 4), (6, [0.0] * 4)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6)}


# secrets and personal data


def plain_spans(text, kinds, tests):
    found = []
    for order, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            if tests.get(kind, lambda m: True)(m):
                found.append((m.start(), order, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


SECRETS = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]
SECRET_TESTS = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
PRIVATE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(m):
    digits = [int(c) for c in m[0] if c.isdigit()]
    return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


PRIVATE_TESTS = {"ip": lambda m: all(int(x) <= 255 for x in m[0].split(".")), "card": luhn, "phone": lambda m: 10 <= sum(c.isdigit() for c in m[0]) <= 15}


def odd_texts():
    rnd = random.Random(6)
    parts = ["token = ", "Password:", "api_key", "'", '"', "=", ": ", "AKIA", "ABCDEFGH0123456789", "0123456789abcdef", "deadbeefdeadbeefdeadbeef", " ", "\n", "é", "\U0001f600", "a@b.c", "_d@e.f", "x.y@", "1.2.3.4", "300.1.1.1", "10.0.0.255", "007.1.1.0", ".5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "12", "-", "secret"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25))) for _ in range(400)]


def test_base_spans_match_plain_matching(spark):
    texts = [*ODD, *odd_texts(), "9" * 20000, "a" * 20000 + "@b.c", "token: token: abcdefgh", "1.2.3.4.5.6.7.8"]
    df = docs_of(spark, texts).repartition(4)
    for found, kinds, tests, order in ((secrets.secret_digests(df), SECRETS, SECRET_TESTS, 3), (pii.pii_digests(df), PRIVATE, PRIVATE_TESTS, 4)):
        rows = {r["doc_id"]: r for r in found.collect()}
        assert len(rows) == len(texts)
        for i, t in enumerate(texts):
            want = plain_spans(t, kinds, tests)
            assert rows[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, rows[i]["spans"], want)
            for k, _ in kinds:
                assert rows[i][f"n_{k}"] == sum(w.startswith(k + ":") for w in want)
            assert set(want) <= set(rows[i]["spans"].split(",")) | {""} and order


def test_weak_credentials_need_their_complement(spark):
    opaque = "Zk3vQ9xLm2Rt8WyB"
    texts = [f"client_id: alpha-7 and {opaque} at https://api.example.com/v1", f"only {opaque} here", "client_id: alpha-7 alone", f"client_id: alpha-7 {'x ' * 300} {opaque}"]
    rows = {r["doc_id"]: r["spans"] for r in secrets.secret_digests(docs_of(spark, texts)).collect()}
    assert [s.split(":")[0] for s in rows[0].split(",")] == ["weak_id", "weak_secret", "endpoint"]
    assert rows[1] == rows[2] == rows[3] == ""


def brute_linked(text, reach=200):
    found = []
    for kind, pattern in (("weak_id", secrets.WEAK_ID), ("access", secrets.ACCESS), ("weak_secret", secrets.WEAK_SECRET), ("hex", secrets.HEX), ("endpoint", secrets.ENDPOINT)):
        for m in re.finditer(pattern, text):
            if kind != "weak_secret" or (re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and not re.match("A[KS]IA[A-Z0-9]+$", m[0])):
                found.append((kind, m.start(), m.end()))
    role = {"weak_id": "i", "access": "i", "weak_secret": "s", "hex": "s", "endpoint": "e"}
    near = lambda x, r: any(role[k] == r and a <= x[2] + reach and x[1] <= b + reach and (x[2] <= a or b <= x[1]) for k, a, b in found)
    out = [x for x in found if (x[0] == "weak_id" and near(x, "s")) or (x[0] == "weak_secret" and near(x, "i")) or (x[0] == "endpoint" and near(x, "s") and near(x, "i"))]
    return {f"{k}:{a}:{b}" for k, a, b in out}


def test_linking_matches_brute_force(spark):
    rnd = random.Random(15)
    parts = ["client_id: alpha-77", "AKIA" + "B2" * 8, "Zk3vQ9xLm2Rt8WyB", "Aa1" * 60, "0123456789abcdef" * 2, "https://api.example.com/v1", "jdbc:postgresql://db/x", "user_name = bob42", "plain words here", "x " * 90, "y " * 30, "é\U0001f600 "]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 9))) for _ in range(250)]
    rows = {r["doc_id"]: r["spans"] for r in secrets.secret_digests(docs_of(spark, texts)).collect()}
    some = 0
    for i, t in enumerate(texts):
        got = {x for x in rows[i].split(",") if x.split(":")[0] in ("weak_id", "weak_secret", "endpoint")}
        assert got == brute_linked(t), t
        some += len(got)
    assert some > 100


def test_contexts_discover_unseen_identifiers(spark, monkeypatch):
    known = [f"please contact staff{i}@mail.example for help" for i in range(30)]
    unseen = [f"please contact EMP-{7000 + i} for help" for i in range(3)]
    other = [f"the size was B{i}00000 then" for i in range(30)]
    rows = {r["doc_id"]: r for r in pii.pii_digests(docs_of(spark, [*known, *unseen, *other])).collect()}
    assert rows[30]["spans"] == "context:15:23" and rows[30]["n_email"] == 0 and rows[40]["spans"] == ""
    monkeypatch.setattr(pii, "BROADCAST_BYTES", -1)
    assert {r["doc_id"]: r for r in pii.pii_digests(docs_of(spark, [*known, *unseen, *other])).collect()} == rows


def test_contexts_to_the_right_and_with_a_gap(spark):
    known = [f"{w} staff{i}@mail.example wrote this note" for i, w in enumerate("a b c d e f g h i j k l m n o p q r s t u v w x y z".split())]
    gapped = [f"{i} x{i}y dear staff{i}@mail.example, thanks {i}" for i in range(30)]
    unseen = ["so EMP-7001 wrote this note", "q dear EMP-7002, thanks so", "dear EMP-7003."]
    rows = {r["doc_id"]: r for r in pii.pii_digests(docs_of(spark, [*known, *gapped, *unseen])).collect()}
    n = len(known) + len(gapped)
    assert rows[n]["spans"] == "context:3:11" and rows[n + 1]["spans"] == "context:7:15" and rows[n + 2]["spans"] == ""


def brute_bootstrap(edges, rounds, support, trust):
    """Patterns and values as dictionaries; edges has (pattern, value, seed)."""
    seed = {}
    for p, v, s in edges:
        seed[p, v] = seed.get((p, v), False) or s
    score = {}
    for (_, v), s in seed.items():
        score[v] = max(score.get(v, 0.0), float(s))
    weight = {}
    for _ in range(rounds):
        held = {}
        for p, v in seed:
            held.setdefault(p, []).append(score[v])
        weight = {p: sum(x) / (len(x) + 1) for p, x in held.items() if sum(y > 0 for y in x) >= support}
        fresh = {}
        for (p, v), s in seed.items():
            if p in weight:
                was = fresh.get(v, (False, 1.0))
                fresh[v] = (was[0] or s, was[1] * (1 - min(weight[p], 0.999)))
        for v, (s, doubt) in fresh.items():
            score[v] = max(score[v], 1.0 if s else 1 - doubt)
    return {(p, v) for (p, v), s in seed.items() if not s and weight.get(p, 0) >= trust and score[v] >= trust}


def test_bootstrap_matches_brute_force(spark):
    rnd = random.Random(14)
    edges = []
    for _ in range(900):
        p = rnd.randrange(25)
        good = rnd.random() < (0.97 if p < 8 else 0.5 if p < 14 else 0.05)
        edges.append((f"p{p} _", f"s{rnd.randrange(120)}" if good else f"t{rnd.randrange(200)}", good))
    df = spark.createDataFrame(edges, "pattern string, value string, seed boolean")
    for rounds, support, trust in ((1, 5, 0.8), (3, 5, 0.8), (2, 3, 0.6)):
        got = {(r["pattern"], r["value"]) for r in pii.bootstrap(df, rounds, support, trust).collect()}
        assert got == brute_bootstrap(edges, rounds, support, trust)
    assert got


def test_redaction_leaves_nothing_behind(spark):
    texts = ["mail a@b.c or 10.0.0.1!", None, "", "clean text", "é +1 (555) 123-4567 \U0001f600"]
    rows = {r["doc_id"]: r["text"] for r in pii.redact(docs_of(spark, texts)).collect()}
    assert rows == {0: "mail <EMAIL> or <IP>!", 1: None, 2: "", 3: "clean text", 4: "é <PHONE> \U0001f600"}


def test_sums_before_over_blocks(spark):
    for n in (0, 1, spans.STEP, spans.STEP + 1, 1000):
        row = spark.range(1).select(spans.sums_before(F.sequence(F.lit(1), F.lit(n)).cast("array<bigint>") if n else F.array().cast("array<bigint>")).alias("s")).first()
        assert row["s"] == [i * (i + 1) // 2 for i in range(n)]


def test_registered_scans_match_plain_matching(spark):
    """op4 and op7 as registered, over a whole table: digests of base spans, and every base span among all spans."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for query, kinds, tests in ((queries.op4_credential_linking, SECRETS, SECRET_TESTS), (queries.op7_bootstrapped_pii, PRIVATE, PRIVATE_TESTS)):
        rows = {r["doc_id"]: r for r in query(spark, SF).collect()}
        assert set(rows) == set(texts)
        for i, t in texts.items():
            want = plain_spans(t, kinds, tests)
            assert rows[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(rows[i]["spans"].split(",")) | {""}


def test_registered_scores(spark):
    rows = queries.op5_compression_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    again = {r["doc_id"]: r["score"] for r in queries.op5_compression_toxicity(spark, SF).collect()}
    assert again == {r["doc_id"]: r["score"] for r in rows}


def test_native_operators_run_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (secrets.secret_digests(docs), pii.pii_digests(docs)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


# toxicity


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, toxicity.learnable(labels))
    held = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rows = [(r["score"] >= 0.5, r["toxic"] == 1) for r in toxicity.toxicity(held, model).select("score", "toxic").collect()]
    right = sum(a == b for a, b in rows) / len(rows)
    recall = sum(a and b for a, b in rows) / sum(b for _, b in rows)
    clean = sum(not a and not b for a, b in rows) / sum(not b for _, b in rows)
    print(f"held out {len(rows)}: accuracy {right:.3f}, recall {recall:.3f}, clean kept {clean:.3f}")
    # few labels at this size; ten times as many give an accuracy of 0.99
    assert right > 0.92 and recall > 0.45 and clean > 0.98


def test_scores_are_those_of_compressed_windows(spark):
    """Scores of a few texts from the model's bytes by zstandard alone."""
    import pickle

    import zstandard

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, toxicity.learnable(labels))
    m = pickle.loads(model)
    assert m["toxic"] and m["ordinary"] and m["ordinary"][-8:] != m["toxic"][-8:]
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(6).collect()] + ["", "short", "Idiot! " * 20]
    rows = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs_of(spark, texts), model).collect()}
    p = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, **toxicity.LEVEL)
    size = lambda window, content: len(zstandard.ZstdCompressor(compression_params=p, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(window))
    for i, text in enumerate(texts):
        words = [w for w in (x.strip(toxicity.EDGE) for x in text.lower().split()) if w]
        cuts = [words[a : a + 12] for a in range(0, max(1, len(words) - 6), 6)] if words else []
        won = [size(x, m["ordinary"]) - size(x, m["toxic"] + m["ordinary"]) for x in ((" " + " ".join(c) + " ").encode("utf-16-le") for c in cuts)]
        z = float(np.dot(toxicity.features(won), m["weights"]))
        assert rows[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_toxicity_edges(spark):
    df = docs_of(spark, ODD)
    one = toxicity.fit(df, df.select("doc_id", F.lit(0).alias("toxic")))
    assert {r["score"] for r in toxicity.toxicity(df, one).collect()} == {0.0}
    none = toxicity.fit(df.limit(0), df.limit(0).select("doc_id", F.lit(0).alias("toxic")))
    assert toxicity.toxicity(df, none).count() == len(ODD)
    mixed = toxicity.fit(df, df.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    rows = toxicity.toxicity(df, mixed).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)


# archives


def test_archives(spark, tmp_path):
    html = ["<p>a</p>", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nfake", "<p>a</p>", None, "", "x" * 200_000, "é\U0001f600"]
    pages = spark.createDataFrame([(i + 10, f"http://h.example/{i}\n x", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    records = warc.read_records(spark, path)
    rows = {r["response"]["record_id"].split(":")[2]: r for r in warc.transactions(records).collect()}
    assert len(rows) == len(html)
    import base64

    for i, h in enumerate(html):
        r = rows[str(i + 10)]
        payload = (h or "").encode()
        assert len(r["requests"]) == 1 and r["metadata"][0]["payload_length"] == len(payload)
        assert r["response"]["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        again = {2: 10, 4: 13}.get(i)
        assert r["response"]["type"] == ("revisit" if again else "response")
        assert r["response"]["refers_to"] == (f"urn:page:{again}" if again else None)
        assert bytes(r["response"]["payload"]) == (b"" if again else payload)


def test_damaged_archives_fail_loudly(spark, tmp_path):
    import gzip

    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(i, "http://h.example/", f"<p>{i}</p>" * 50) for i in range(5)], "page_id long, url string, html string").coalesce(1), path)
    (file,) = (tmp_path / "w").glob("*.gz")
    plain = gzip.decompress(file.read_bytes())
    assert len(list(warc.records_of(plain))) == 15
    for broken in (plain[:-40], plain.replace(b"Content-Length: ", b"Content-Size: ", 1), file.read_bytes()[:-30]):
        with pytest.raises(warc.DamagedArchive):
            list(warc.records_of(broken))
    flipped = tmp_path / "f"
    flipped.mkdir()
    (flipped / "a.gz").write_bytes(gzip.compress(plain.replace(b"<p>3</p>", b"<p>4</p>")))
    by_page = {r["page_id"]: r for r in warc.page_captures(warc.transactions(warc.read_records(spark, str(flipped), payloads=False))).collect()}
    # figures are those of the body read back, not what the header says
    assert by_page[3]["payload_digest"] == by_page[4]["payload_digest"]
    (flipped / "a.gz").write_bytes(gzip.compress(plain[:-40]))
    assert warc.read_records(spark, str(flipped), damaged="skip").count() == 14


def test_archive_query(spark):
    df = queries.op6_warc_transactions(spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/pages.parquet").count() and df.where("payload_bytes is null or n_requests <> 1").count() == 0


# mixing


def test_targets_share_by_weight_under_caps(spark):
    for sizes in ({"a": 100, "b": 100, "c": 100, "d": 1000}, {"a": 0, "b": 10, None: 500}, {"x": 7}):
        rows = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = dict(zip(names, [3, 1, 2] * len(names), strict=False))
        left, open_, want = 1.5 * sum(sizes.values()), set(names), {}
        while open_:
            level = left / sum(weight[s] for s in open_)
            over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
            if not over:
                want |= {s: weight[s] * level for s in open_}
                break
            for s in over:
                want[s] = 2 * sizes[s]
                left -= want[s]
            open_ -= over
        assert rows == pytest.approx(want)


def test_mix_is_near_targets_and_repeats(spark):
    rnd = random.Random(8)
    texts = [*ODD, *(prose(rnd, rnd.randrange(1, 80)) for _ in range(600))]
    df = docs_of(spark, texts)
    rows = mixing.mix_documents(df).collect()
    assert len(rows) == len(texts) and all(0 <= r["copies"] <= 2 for r in rows)
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= 2 * max(r["size"] for r in mine)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix_documents(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}
    assert mixing.mixed_rows(df).count() == sum(r["copies"] for r in rows)
    double = df.unionByName(df.limit(200))
    own = mixing.mix_documents(double)
    taken = {tuple(r): n for r, n in ((r[:2], r[2]) for r in own.groupBy("doc_id", "size").agg(F.sum("copies").alias("n")).collect()) if n}
    drawn = {tuple(r[:2]): r[2] for r in mixing.mixed_rows(double).groupBy("doc_id", mixing.word_count("text").alias("size")).count().collect()}
    assert drawn == taken and set(mixing.mixed_rows(df).columns) == set(df.columns)
    assert mixing.mix_documents(df.limit(0)).count() == 0


# near duplicates


def brute_classes(texts, k=4):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    s = [shingles(t) for t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    return [len(x) for x in s], part


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    rnd = random.Random(9)
    texts = list(ODD)
    for _ in range(12):
        base = prose(rnd, 120).split()
        for e in range(12):
            w = list(base)
            for _ in range(e // 2):
                w[rnd.randrange(len(w))] = "edit" + str(rnd.randrange(99))
            texts.append(" ".join(w))
    sizes, part = brute_classes(texts)
    for small in (False, True):
        if small:  # large families go by bucket and in pairs of blocks
            monkeypatch.setattr(neardup, "BLOCK_DOCS", 3)
            monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 500)
        rows = {r["doc_id"]: r for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
        assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
        assert [rows[i]["component_id"] for i in range(len(texts))] == part
        assert all(r["kept"] == (r["component_id"] == i) for i, r in rows.items())
    assert neardup.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_signature_is_two_permutations():
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(neardup._scatter(x))) == len(x)
    s = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 400).astype(np.uint64))
    a, b = neardup.circulant_signature(s[:360], 512), neardup.circulant_signature(s[40:], 512)
    assert abs((a == b).mean() - 320 / 400) < 0.06


# repeated phrases


def brute_removed(texts, window):
    seen = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for w in split:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window,phrase", [(35, 12), (6, 3), (5, 5)])
def test_repeats_match_brute_force(spark, window, phrase):
    rnd = random.Random(10)
    passages = [prose(rnd, rnd.randrange(window, window + 30)) for _ in range(6)]
    texts = [*ODD, "a a a a a a a a a a " * 9]
    for _ in range(60):
        parts = [prose(rnd, rnd.randrange(0, 50)) for _ in range(3)]
        parts.insert(rnd.randrange(3), rnd.choice(passages))
        if rnd.random() < 0.3:
            parts.append(" ".join(rnd.choice(passages).split()[: window - 1]))
        texts.append("  \n".join(parts))
    rows = {r["doc_id"]: r for r in phrases.without_repeats(docs_of(spark, texts), window, phrase).collect()}
    assert [(rows[i]["n_words"], rows[i]["n_removed"], rows[i]["kept_text"]) for i in range(len(texts))] == brute_removed(texts, window)


def test_only_automata_locate(spark, monkeypatch):
    """What the automata don't find stays, however often it recurs; a passage is found in documents that didn't quote it."""
    words = prose(random.Random(12), 60)
    docs = docs_of(spark, [words, "x y z " + words, words + " tail"])
    assert [r["n_removed"] for r in phrases.without_repeats(docs).collect()] == [60] * 3
    automaton = phrases.Automaton({b"a b": True, b"b c": False, b"zz y": True})
    assert automaton.found(b"x a b c d a b".split(), 2).tolist() == [-1, 1, 0, -1, -1, 1, -1] and automaton.found([], 2).tolist() == [-1]
    many = [b"w%d v%d" % (i, i) for i in range(70_000)]
    wide = phrases.Automaton(dict.fromkeys(many, False))
    text = b" ".join(many[::1000]).split()
    assert wide.found(text, 2).tolist() == [0, -1] * 70
    monkeypatch.setattr(phrases.Automaton, "found", lambda self, words, length: np.full(max(1, len(words)), -1, np.int8))
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(phrases)
    try:
        assert [r["n_removed"] for r in phrases.without_repeats(docs).collect()] == [0] * 3
    finally:
        cloudpickle.unregister_pickle_by_value(phrases)


def test_many_shards_agree_with_one(spark, monkeypatch):
    rnd = random.Random(13)
    passages = [prose(rnd, 50) for _ in range(4)]
    texts = [prose(rnd, 20) + " " + rnd.choice(passages) + " " + prose(rnd, 20) for _ in range(40)] + passages
    whole = brute_removed(texts, 35)
    monkeypatch.setattr(phrases, "SHARD", 600)
    rows = {r["doc_id"]: r for r in phrases.without_repeats(docs_of(spark, texts)).collect()}
    assert [(rows[i]["n_words"], rows[i]["n_removed"], rows[i]["kept_text"]) for i in range(len(texts))] == whole


def test_anchors_are_the_same_by_either_way(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (1, 34, 35, 36, 500):
        for words in (3, 1000):
            h = rng.integers(0, words, n).astype(np.uint64)
            fast = phrases.anchors(h, 35, 12)
            g = phrases.gram_hashes(h, 12)
            if len(g) >= 24:
                picked = phrases._leftmost(g & np.uint64(~phrases.PLACES & 0xFFFFFFFFFFFFFFFF), 24)
                assert np.array_equal(np.repeat(fast[0], fast[2] - fast[1] + 1), picked)
            else:
                assert not len(fast[0])


def test_repeats_with_repeated_ids_and_no_rows(spark):
    text = prose(random.Random(11), 50)
    df = spark.createDataFrame([(1, text), (1, text), (1, "other words"), (None, None)], "doc_id long, text string")
    rows = sorted((r["n_words"], r["n_removed"]) for r in phrases.without_repeats(df).collect())
    assert rows == [(0, 0), (2, 0), (50, 50), (50, 50)]
    assert phrases.without_repeats(df.limit(0)).count() == 0


# extra columns


def test_clashing_columns(spark):
    df = docs_of(spark, ODD)
    for name in ("size", "score", "copies", "base_spans", "spans", "component_id", "kept", "piece", "length", "rep", "id", "n", "row_key", "z"):
        df = df.withColumn(name, F.lit("mine"))
    assert mixing.mix_documents(df).count() == len(ODD)
    assert secrets.secret_spans(df).count() == len(ODD) and pii.pii_spans(df).count() == len(ODD)
    assert neardup.near_duplicates(df).count() == len(ODD) and phrases.without_repeats(df).count() == len(ODD)
    model = toxicity.fit(df, df.select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.toxicity(df, model).count() == len(ODD)
    assert packing.pack_documents(df).count() >= len(ODD) and media.read_media(media.text_media(df)).count() == len(ODD)
