"""Secrets, packing, decontamination, archives, models and the pipeline against plain versions, with odd rows."""

import math
import re
import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_near_groups import all_pairs
from tokenizers import Tokenizer

from trialspark.llm import archives, decontam, langid, lm, packing, queries, secret_scan, toxicity

DIR = "/root/testdata/sf0.001"
TOKENS = public_tokenizers.path("word_bpe_49k.json")
AWS = "AKIA" + "ABCDEFGH12345678"
BARE = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"


def docs_of(spark, rows, extra="score double, _uid string, h long"):
    return spark.createDataFrame([(d, t, 1.0, "u", 5) for d, t in rows], f"doc_id long, text string, {extra}")


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (None, "no id"), (5, "é" * 5000), (6, "a " * 20_000), (7, "\U0001f600 x\u0000y")]


# secrets

SECRET_TEXTS = [
    (1, f"id {AWS} then {BARE} at https://host.example/path"), (2, f"{BARE} alone, https://host.example"), (3, f"{AWS}\n\n{BARE}"),
    (4, f"{AWS} " + "x" * 400 + f" {BARE}"), (5, "TOKEN = \"abcdef\" PassWord:abc api-key=zzzzzzz apikey : 'q1w2e3r4' pasſword=abcdefgh"),
    (6, "é" * 7 + "secret=" + "0123456789abcdef" * 2), (7, "user=bob password=hunter22 db.example.com:5432"), (8, "user=bob only"),
    (9, None), (10, ""), (None, f"{AWS}"), (11, "token=" * 3000), (12, "AKIA" * 9 + " AKIAshort deadbeef" * 3 + "0" * 24), (1, f"{AWS}"),
]


def test_base_spans_match_the_patterns(spark):
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.scan(docs_of(spark, SECRET_TEXTS)).select(
        "doc_id", *(secret_scan.count_of(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secret_scan.listing("base").cast("binary"), 256).alias("base_sha256")).collect()), key=repr)
    assert got == sorted(((d, *brute.secrets(t)) for d, t in SECRET_TEXTS), key=repr)


def test_weak_parts_need_their_complement(spark):
    rows = secret_scan.scan(docs_of(spark, SECRET_TEXTS[:8])).select("doc_id", secret_scan.listing("spans").alias("s")).collect()
    kinds = {r.doc_id: [x.split(":")[0] for x in r.s.split(",") if x] for r in rows}
    assert kinds[1] == ["access", "key", "address"] and kinds[2] == [] and kinds[3] == ["access"] and kinds[4] == ["access"]
    assert kinds[7] == ["user", "assign", "address"] and kinds[8] == []


def test_redaction(spark):
    got = {r.doc_id: r.text for r in secret_scan.redact(docs_of(spark, SECRET_TEXTS[:10])).collect()}
    assert got[1] == "id [SECRET] then [SECRET] at [SECRET]" and got[6] == "é" * 7 + "[SECRET]" and got[8] == "user=bob only"
    assert got[9] is None and got[10] == ""


def test_long_words_are_scanned_in_time():
    import time

    for w in ("data:" + "a" * 1_000_000, "a." * 500_000 + ":x", "a:" * 400_000, "://" * 300_000, "Aa1+" * 250_000, "password" * 120_000, "key=" + "f" * 1_000_000):
        start = time.perf_counter()
        secret_scan.parts_of(pa.record_batch([pa.array([w])], names=["text"]))
        assert time.perf_counter() - start < 20


def test_addresses_equal_the_pattern():
    """Read backwards from colons, against one leftmost pattern."""
    pattern = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D"'<>]+|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}""")
    rng = np.random.default_rng(1)
    for alphabet in ("ab.:/9\"", "a.:9", "aB+-.:/1<", "a:/.", "x1.:/"):
        for n in rng.integers(1, 24, 4000):
            w = "".join(rng.choice(list(alphabet), n))
            assert secret_scan.addresses(w) == [m.span() for m in pattern.finditer(w)]


def test_linking_equals_all_pairs_of_parts(spark):
    rng = np.random.default_rng(6)
    rows = []
    for uid in range(60):
        for _ in range(int(rng.integers(0, 25))):
            start = int(rng.integers(0, 3000))
            rows.append((uid, start, int(rng.integers(0, 6)), start + int(rng.choice([1, 40, 900])), int(rng.integers(0, 2))))
    rows = list(dict.fromkeys(rows))
    near = lambda w, o: o[0] == w[0] and o[4] == w[4] and o[1] - w[3] <= 300 and w[1] - o[3] <= 300
    has = lambda w, kinds: any(o[2] in kinds and near(w, o) for o in rows)
    secrets, names = (0, 2, 4), (1, 3)
    want = [w for w in rows if (w[2] == 3 and has(w, secrets)) or (w[2] == 4 and has(w, names)) or (w[2] == 5 and has(w, secrets) and has(w, names))]
    got = secret_scan.link(spark.createDataFrame(rows, "_uid long, start long, kind int, end long, scope int"))
    assert sorted((r._uid, r.start, r.kind, r.end, r.scope) for r in got.collect()) == sorted(want) and len(want) > 50


# packing

def test_packing_is_exact_and_gapless(spark):
    rows = ODD + [(100 + i, "the cat sat on the mat, it's 42! " * (i * 7)) for i in range(60)]
    got = packing.pack_documents(docs_of(spark, rows), TOKENS, limit=512, places=8, with_ids=True).collect()
    t = Tokenizer.from_file(TOKENS)
    want = []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(d, n, s, ids[s:s + 512]) for n, s in enumerate(range(0, len(ids), 512))]
    assert sorted(((r.doc_id, r.piece, r.start, list(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 512
    assert packing.pack_documents(docs_of(spark, []), TOKENS).count() == 0


def test_packer_is_best_fit_with_bounded_places():
    rng = np.random.default_rng(0)
    p, free, made = packing.Packer(100, 5), {}, 0
    for n in rng.integers(1, 101, 3000).tolist():
        fit = [s for s in free if free[s] >= n]
        least = min((free[s] for s in fit), default=None)
        s, o = p.put(n)
        if least is None:
            if len(free) == 5:
                low = min(free.values())
                gone = [x for x in free if free[x] == low]
                free.pop(gone[0] if len(gone) == 1 else max(gone, key=lambda x: (x not in p.by_free[low], x)))
            assert s == made and o == 0
            free[s], made = 100, made + 1
        else:
            assert free[s] == least and o == 100 - least
        free[s] -= n
        if not free[s]:
            del free[s]
        assert p.open == len(free) <= 5


def test_word_ids_equal_the_tokenizer():
    t = Tokenizer.from_file(TOKENS)
    odd = ["it's  we'll <|endoftext|> x<|startoftext|>y", "İs ẞ éx H̱ 中文 12a3 \x1cf\x85b\xa0z　x", "''s' \"'s ``", "ΣΑΣ ς ǆ ﬁ ½", "'S 'LL I'M"]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.WordIds(TOKENS).of(odd)] == [t.encode(x, add_special_tokens=False).ids for x in odd]


# decontamination

QUESTION = "If Anna buys 12 red apples and Tom sells 5 of them for 3 dollars each, how many apples does Anna keep at home today?"


def test_contamination(spark):
    other = QUESTION.replace("12", "40").replace("5 of", "9 of").replace("3 dollars", "7 euros").replace("Anna", "Berta").replace("Tom", "Uli")
    mixed = other.replace("does Berta", "does Carla")
    rows = [(1, "Before. " + QUESTION.upper().lower() + " After."), (2, other), (3, "nothing here at all " * 30), (4, mixed), (2, other), *ODD]
    items = spark.createDataFrame([(7, QUESTION, 1), (8, None, 1), (9, "", 1), (10, "too short", 1), (11, "seven words make one short item here", 1)], "item_id long, text string, h int")
    rows.append((12, "say: seven words make one short item here, ok"))
    got = {(r.doc_id, r.item_id, r.kind) for r in decontam.contaminated(docs_of(spark, rows), items).collect()}
    assert {x for x in got if x[0] == 2} == {(2, 7, "reparameterised")}
    assert {x[:2] for x in got} == {(1, 7), (2, 7), (12, 11)}


def test_contamination_of_the_query_table(spark):
    docs, items = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    clean = lambda t: [w for w in ("".join(c for c in w if c.isalnum()) for w in t.lower().split()) if w]
    grams = {}
    for r in items.collect():
        w = clean(r.text)
        for i in range(len(w) - 7):
            grams.setdefault(tuple(w[i:i + 8]), set()).add((r.item_id, i, len(w) - 7))
    want = set()
    for r in docs.collect():
        w = clean(r.text)
        met = Counter((x[0], x[2]) for x in set().union(*(grams.get(tuple(w[i:i + 8]), set()) for i in range(len(w) - 7)))) if len(w) > 7 else {}
        want |= {(r.doc_id, i) for (i, n), k in met.items() if k / n >= 0.5}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == want
    assert decontam.contaminated(docs.limit(0), items).count() == decontam.contaminated(docs, items.limit(0)).count() == 0


# archives

def test_archives(spark, monkeypatch):
    monkeypatch.setattr(archives, "PER_FILE", 4)
    long = "<p>" + "\r\nWARC/1.1\r\n\r\n" * 3000
    rows = [(5, "http://a/x y\n", "<p>é</p>"), (3, "http://b/", "<p>é</p>"), (1, None, None), (2, "u", ""), (9, "u", long), (9, "u", long), (None, "u", "n"), (None, "v", "n"), (8, "w", "n")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    got = archives.archive_pages(pages).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == sorted([
        (False, 5, 9, "revisit", 3), (False, 3, 9, "response", 0), (False, 1, 0, "response", 0), (False, 2, 0, "revisit", 1),
        (False, 9, len(long), "response", 0), (False, 9, len(long), "revisit", 9), (True, 0, 1, "revisit", 8), (True, 0, 1, "revisit", 8), (False, 8, 1, "response", 0)])
    assert all(r.payload_digest == archives.digest_of(next((h or "").encode() for p, _, h in rows if p == r.page_id)) for r in got)
    assert archives.archive_pages(pages.limit(0)).count() == 0


def test_archive_files_end_by_bytes_and_ids_are_unique(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(archives, "FILE_BYTES", 5000)
    pages = spark.createDataFrame([(7, "http://a", "x" * 3000)] * 4 + [(None, "http://b", "y" * 100)] * 3 + [(8, None, "z" * 20_000)], "page_id long, url string, html string").coalesce(1).checkpoint()
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    archives.write_arc(pages, arc)
    archives.arc_to_warc(spark, arc, warc)
    assert len(list((tmp_path / "arc").glob("part-*"))) >= 4
    ids, refers = [], []
    for f in sorted((tmp_path / "warc").glob("part-*")):
        for fields, _ in archives.read_warc(archives.unzip(f.read_bytes())):
            ids.append(fields["warc-record-id"])
            refers += [fields["warc-refers-to"]] if "warc-refers-to" in fields else []
    assert len(ids) == len(set(ids)) >= 8 and len(refers) == 5 and set(refers) <= set(ids)
    assert archives.read_warc_files(spark, warc).count() == 8


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip_and_faults(version):
    blocks = [archives.http_block(i, b"x" * i + b"\nhttp://z 1 2 3 4\n") for i in range(5)]
    data = archives.arc_version_block(version, "f") + b"\n" + b"\n".join(archives.arc_record(version, f"http://h/{i} ", b) for i, b in enumerate(blocks)) + b"\n\n"
    read = list(archives.read_arc(data))
    assert [r.block for r in read] == blocks and read[3].fields["URL"] == "http://h/3%20" and tuple(read[0].fields) == archives.FIELDS[version]
    for bad in (data[:-20], data + b"no header\n"):
        with pytest.raises(ValueError):
            list(archives.read_arc(bad))
    assert archives.iso("1999") == "1999-01-01T00:00:00Z"


# models

def test_lm_base_score_and_normalisation(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 300)
    monkeypatch.setattr(lm, "LONGEST", 8)
    monkeypatch.setattr(lm, "STEPS", 5)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string"))
    rows = docs.collect()
    got = lm.score_documents(docs.withColumn("n", F.lit("clash")).withColumn("token", F.lit(1)), queries.remainder(7) == 2).collect()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    c = Counter()
    for r in rows:
        if not held(r.doc_id):
            c.update(lm.words_of(r.text))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        w = lm.words_of(r.text)
        want.append((r.doc_id, held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == sorted(want, key=repr)
    assert lm.score_documents(docs.limit(0), F.lit(False)).count() == 0


def test_lm_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    r = lm.score_documents(docs, queries.remainder(7) == 2).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_lm_score_equals_a_plain_rescoring(spark, monkeypatch):
    """Every token through explicit softmaxes over all groups and all members, in plain loops."""
    monkeypatch.setattr(lm, "HEAD", 120)
    monkeypatch.setattr(lm, "STEPS", 20)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").where("length(text) < 400").limit(40).union(spark.createDataFrame(ODD[:6], "doc_id long, text string")).checkpoint()
    model, counts = lm.fit(docs.where("doc_id % 3 <> 0"))
    got = sorted(lm.score(docs.withColumn("held_out", F.lit(False)), model, counts).collect(), key=repr)
    n = {bytes(r.token): r.n for r in counts.collect()}
    t = lm.Tables(model)
    groups = len(model.starts) - 1
    modelled = {w: int(model.symbols[i]) for w, i in t.ids.items() if int(model.symbols[i]) not in set(model.starts[:-1].tolist())}
    rest = {g: [w for w in n if w not in modelled and lm.group_of(w, groups) == g] for g in range(groups)}

    def symbol(w):
        return modelled.get(w, int(model.starts[lm.group_of(w, groups)]))

    def logp(w, h1, h2):
        g, k = lm.group_of(w, groups), symbol(w)
        q = model.places[0].astype(float) * model.contexts[symbol(h1)] + model.places[1].astype(float) * model.contexts[symbol(h2)]
        top = [math.exp(float(q @ model.groups[0][i]) + float(model.groups[1][i])) for i in range(groups)]
        own = [math.exp(float(q @ model.members[0][j]) + float(model.members[1][j])) for j in range(model.starts[g], model.starts[g + 1])]
        p = top[g] / sum(top) * own[k - model.starts[g]] / sum(own)
        if w not in modelled:
            p *= (n.get(w, 0) + 1) / (sum(n[x] for x in rest[g]) + len(rest[g]) + 1)
        return math.log10(p)

    want = []
    for r in docs.collect():
        w = [lm.END, lm.END, *lm.words_of(r.text)]
        want.append((r.doc_id, sum(logp(w[i], w[i - 1], w[i - 2]) for i in range(2, len(w)))))
    assert len(got) == len(want)
    for a, b in zip(sorted(((r.doc_id, r.score) for r in got), key=repr), sorted(want, key=repr), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-3 * max(1, abs(b[1]))


def test_lm_probabilities_sum_to_one_and_learn_contexts():
    """A language in which the token two before decides the next one."""
    rng = np.random.default_rng(0)
    head = [(lm.END, 10), *((f"w{i:02d}".encode(), 100 - i) for i in range(30))]
    symbols, starts, seen = lm.lay_out(head, 31, 4)
    assert sorted(np.concatenate([symbols, starts[:-1]]).tolist()) == list(range(35))
    x = rng.integers(0, 30, 20_000)
    x[2:] = np.where(rng.random(len(x) - 2) < 0.9, (x[:-2] * 7 + 3) % 30, x[2:])
    for i in range(2, len(x)):
        if rng.random() < 0.9:
            x[i] = (x[i - 2] * 7 + 3) % 30
    s = symbols[1:][x]
    seen[starts[:-1]] = 1
    parts = lm.train(np.column_stack([s[2:], s[1:-1], s[:-2]]), starts, seen + 1)
    packed = b"".join(len(w).to_bytes(4, "little") + w for w, _ in head)
    t = lm.Tables(lm.Model(packed, np.array([n for _, n in head], float), symbols, starts, *parts, np.zeros(4), 1000, 31))
    every = np.arange(35)
    for h1, h2 in ((0, 3), (5, 5), (34, 1)):
        assert abs((10 ** t.log_probabilities(every, np.full(35, h1), np.full(35, h2))).sum() - 1) < 1e-5
    p = 10 ** t.log_probabilities(s[2:1002], s[1:1001], s[:1000])
    assert np.exp(np.log(p).mean()) > 0.25  # 1/30 without the context


def test_lm_gathers_more_from_more_text(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    small, large = (lm.fit(d)[0] for d in (docs.where("doc_id % 8 = 0"), docs))
    assert large.tokens > 4 * small.tokens and len(large.members[1]) > 1.5 * len(small.members[1]) and len(large.starts) > len(small.starts)


def test_language_id(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    held = queries.remainder(5) == 0
    model = langid.fit(langid.sample_segments(docs.where(~held)))
    got = langid.identify(docs.where(held).withColumn("score", F.lit("clash")), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = langid.identify(docs_of(spark, [*ODD, (8, "12 !? 34")]), model, with_words=True).collect()
    assert len(odd) == len(ODD) + 1 and {r.lang_pred for r in odd if r.doc_id in (1, 2, 3, 8)} == {"und"}
    parts = {r.lang: r.text.split()[:40] for r in docs.where("length(text) > 400").collect()}
    a, b = list(parts)[:2]
    mixed = langid.identify(docs_of(spark, [(1, " ".join(parts[a] + parts[b]))]), model, with_words=True).first()
    by_word = [w.lang for w in mixed.words for _ in range(w.first, w.end)]
    assert by_word[:35].count(a) > 28 and by_word[-35:].count(b) > 28
    none = langid.fit(langid.sample_segments(docs.limit(0)))
    assert langid.identify(docs, none).where("lang_pred = 'und'").count() == docs.count()


def test_language_id_with_many_and_rare_languages(spark):
    """Seventy languages, one of them with a few texts among thousands, and one text repeated many times."""
    stem = [a + b for a in "bdfgklmnpr" for b in ("ab", "ek", "im", "op", "ur", "aß", "yn")]
    rows = [(i, f"{stem[i % 70]}tor{stem[i % 70]} {stem[i % 70]}lin {stem[i % 70]}mes", f"l{i % 70:02d}") for i in range(700)]
    rows += [(10_000 + i, f"zug{'xyz'[i % 3]} zugzug zagzag", "rare") for i in range(4)]
    rows += [(20_000, "mota lexb", "l01")] * 6000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    segments = langid.sample_segments(docs)
    assert {y for y, _ in segments} == {f"l{i:02d}" for i in range(70)} | {"rare"} and sum(w == ["mota", "lexb"] for _, w in segments) <= 1
    model = langid.fit(segments, epochs=12)
    assert len(model.langs) == 71
    got = {r.doc_id: r for r in langid.identify(docs.where("doc_id < 20000"), model).collect()}
    assert sum(r.lang == r.lang_pred for r in got.values()) > 0.9 * len(got)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    e, moves, start = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    gamma, pair, _ = langid.forward_backward(e, np.ones((4, 1), bool), moves, start)
    want, want_pair, total = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for y in np.ndindex(3, 3, 3, 3):
        p = math.exp(start[y[0]] + sum(e[t, 0, y[t]] for t in range(4)) + sum(moves[y[t], y[t + 1]] for t in range(3)))
        total += p
        for t in range(4):
            want[t, y[t]] += p
        for t in range(3):
            want_pair[y[t], y[t + 1]] += p
    assert np.allclose(gamma[:, 0], want / total) and np.allclose(pair, want_pair / total)


def test_toxicity_learns_insults_with_gaps(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("aeiourtnsl"), int(rng.integers(3, 9))))
    bad = ("grumbok", "zwipfel")
    texts = []
    for i in range(300):
        w = [word() for _ in range(20)]
        if i % 3 == 0:
            w[i % 20] = bad[i % 2]
        texts.append((int(i % 3 == 0), toxicity.pieces_of(" ".join(w))))
    machine = toxicity.fit(texts)
    rows = [(1, "rato grumbok sale"), (2, "rato gru-mbok sale"), (3, "tuli g r u m b o k ras"), (4, "rato grumxbok sale"), (5, "rato sale tone lira"), *((10, t) for _, t in ODD)]
    got = toxicity.score(docs_of(spark, rows), machine).collect()
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    assert {r.doc_id for r in got if r.predicted} == {1, 2, 3, 4}
    assert toxicity.fit([]).logistic[-1] < 0 and toxicity.fit([(1, [])]).logistic[-1] > 0


def test_kernel_equals_the_sum_over_common_triples():
    def weights(s):
        line, out = f"^{s}$", Counter()
        for i in range(len(line)):
            for j in range(i + 1, len(line)):
                for k in range(j + 1, min(len(line), i + toxicity.REACH)):
                    out[line[i] + line[j] + line[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    def value(a, b):
        x, y = weights(a), weights(b)
        return sum(v * y[t] for t, v in x.items())

    words = ["idiot", "idixot", "aa", "loser", "closer"]
    want = [[value(a, b) / math.sqrt(value(a, a) * value(b, b)) for b in words] for a in words]
    assert np.allclose(toxicity.kernel(words, words), want)


def test_toxicity_query(spark):
    got = queries.QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = got.join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    assert r > 0.9


def test_toxicity_sample_takes_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(600)] + [(2, "fine words"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, None), (2, 5)], "doc_id long, toxic int")
    assert sorted(y for y, _ in toxicity.sample(docs, labels)) == [0, 1]
    assert toxicity.sample(docs.limit(0), labels) == []


# pipeline

def test_pipeline_matches_a_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    component = all_pairs(rows)[1]  # of pairs (doc_id, smallest doc_id of its component)
    rows = [r for r in rows if (r[0], r[0]) in component]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    leaks = {r.doc_id for r in decontam.contaminated(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
    spans = {r.doc_id: [x.asDict() for x in r.spans] for r in secret_scan.scan(docs).collect()}
    t = Tokenizer.from_file(TOKENS)
    want = []
    for d, text in rows:
        if d not in leaks:
            ids = [*t.encode(secret_scan.mask(text, spans[d]), add_special_tokens=False).ids, 1]
            want += [(d, n, len(ids[s:s + 4096]), zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), 4096))]
    got = corpus_pipeline.run(spark, DIR).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_stages_keep_unknown_columns(spark):
    schema = "score string, doc_id long, _uid int, text string, lang string, spans string, n_chars long"
    data = [("s", 1, 3, "hello the world is here", "en", "z", 23), ("s", 1, 3, "hello the world is here", "en", "z", 23), ("t", None, None, None, None, None, None),
            ("u", 2, 1, "", "en", "z", 0), ("v", 3, 1, f"le monde {AWS} est ici", None, "z", 40), ("w", None, 1, "andere worte sind das", "de", "z", 21)]
    docs = spark.createDataFrame(data, schema).checkpoint()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR).checkpoint()
        assert docs.columns == [x.split()[0] for x in schema.split(", ")]
    got = {(r.score, r.doc_id, r.text, r.n_chars) for r in docs.collect()}
    assert got == {("s", 1, "hello the world is here", 23), ("v", 3, "le monde [SECRET] est ici", 25), ("w", None, "andere worte sind das", 21)}
    assert docs.count() == 3
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DIR).count() == 0
