"""Each operator against a plain version on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sheetspark.llm import features, fingerprint, jaccard, mixing, neardup, packing, pii, quality, queries, repeats, text, tokens, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra map<string,int>"


def prose(r, n, vocabulary=400):
    name = lambda k: "".join("abcdefghij"[int(d)] for d in str(k)) + "o"
    return " ".join(name(r.randrange(vocabulary)) + r.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    base = prose(r, 120)
    near = base.split()
    near[60] = "changed"
    shared = prose(r, 60)
    texts = [base, " ".join(near), base, None, "", "  \n", "one two", "ONE Two", "x", shared + " " + prose(r, 30), prose(r, 40) + " " + shared, prose(r, 9000), "a b c d e", "é" * 300 + " " + "é" * 300]
    texts += [prose(r, r.randrange(1, 200)) for _ in range(25)]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t), None) for i, t in enumerate(texts)]
    return out + [out[0], (None, base, None, "s0", 1, None)]  # a repeated row, a row without an id


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def shingle_set(t):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def test_word_hashes_depend_on_words_alone():
    a = pa.array(["The the\tTHE", None, "x the", "\x0bthe "])
    offsets, data = text.strings(a)
    starts, hashes = text.words(offsets, data)
    assert len(hashes) == 6 and len(set(hashes.tolist())) == 2
    assert [len(s) for s in text.shingle_sets(a)] == [1, 0, 1, 1]
    big = pa.array(["ab " * 700_000])
    assert len(text.words(*text.strings(big))[0]) == 700_000 and len(set(text.words(*text.strings(big))[1].tolist())) == 1


def test_pii_base_and_added_spans(docs, nothing, rows):
    assert {r.doc_id for r in pii.find(docs).collect()} == {r[0] for r in rows}
    assert pii.find(nothing).count() == 0 and pii.redact(nothing).count() == 0
    t = "mail a.b@c.org or 10.0.0.256 10.0.0.25, card 4539 1488 0343 6467, +1 (252) 555-3453; token = \"0641917ea4e9feb9\""
    base, every = pii.spans_of(t)
    assert [(t[a:b], k) for a, b, k in base] == [("a.b@c.org", "email"), ("10.0.0.25", "ip"), ("4539 1488 0343 6467", "card"), ("+1 (252) 555-3453", "phone")]
    assert [t[a:b] for a, b, k in every if k == "secret"] == ["0641917ea4e9feb9"]
    assert pii.masked(t, every).count("[") == 5


def test_pii_base_spans_against_plain_regexes():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(t):
        for k, p in patterns.items():
            for m in re.finditer(p, t):
                g, d = m.group(), re.sub("[^0-9]", "", m.group())
                if (k == "ip" and any(int(x) > 255 for x in g.split("."))) or (k == "card" and not (14 <= len(d) <= 19 and pii.luhn(d))) or (k == "phone" and not 10 <= len(d) <= 15):
                    continue
                yield m.start(), m.end(), k

    r = random.Random(3)
    for _ in range(4000):
        t = "".join(r.choice("ab.@@1234567890..-+ (é") for _ in range(r.randint(0, 60)))
        assert sorted(plain(t), key=lambda s: (s[0], pii.ORDER[s[2]])) == pii.base_spans(t)


def test_pii_model_on_sentences_it_has_not_seen():
    held = pii.training_sentences(120, 99)
    assert sum(set(pii.spans_of(t)[1]) == want for t, want in held) >= 0.95 * len(held)
    assert pii.base_spans("1" * 20000 + "." * 20000) == []


def test_tokens_are_those_of_the_tokenizer():
    tok = tokens.WordTokenizer(tokens.default_path())
    r = random.Random(1)
    texts = ["".join(r.choice("ab'!.,é× É3—́  ßK\x1c\n\t=中😀'sRE") for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["<|endoftext|> a", "it's don't !'s 'T", "", None]
    want = [e.ids for e in tok.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in tok.of(*text.strings(pa.array(texts)))] == want


def test_packing(spark, docs, nothing, rows):
    from sheetspark.llm.storage import keep

    tok = tokens.WordTokenizer(tokens.default_path())
    pieces = keep(packing.cut(docs), "pieces")
    out = packing.pack(pieces, block=16).toPandas()
    assert len(out) == pieces.count()
    per = Counter()
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= 2048
    for i, t, *_ in rows:
        ids = tok.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, start in enumerate(range(0, len(ids), 2048)):
            per[i, k, start, min(2048, len(ids) - start), zlib.crc32(np.array(ids[start : start + 2048], "<u4").tobytes())] += 1
    clean = [None if i != i else int(i) for i in out.doc_id]
    assert Counter(zip(clean, out.piece, out.start, out.length, out.ids_crc32)) == per
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 2048) + 1
    assert packing.pack(keep(packing.cut(nothing), "pieces")).count() == 0


def test_genetic_operators_keep_every_piece():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2048, 300)
    every = np.arange(300)
    a = packing.compact(packing.best_fit(lengths, np.zeros(300, int), every, 2048))
    b = packing.compact(packing.best_fit(lengths, np.zeros(300, int), every, 2048, rng.random(300)))
    for child in (packing.crossover(a, b, lengths, 2048, rng), packing.mutate(a, lengths, 2048, rng), packing.evolve(lengths, 1, np.stack([a, b]))):
        assert len(child) == 300 and np.bincount(child, lengths).max() <= 2048


def test_warc_round_trip(spark, tmp_path):
    long, longer = "x" * 100, "é" * 80
    pages = [(5, "u5", long, 1), (2, "u2", long, 1), (9, "u\r\n9", long, 1), (1, None, "short", 1), (3, "u3", "short", 1), (4, "u4", None, 1), (6, "u6", longer, 1), (7, "u7", longer, 1), (2, "u2", long, 1), (None, "n", long, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, bytes int")
    archive = warc.write_archive(df, f"file://{tmp_path}/a")
    got = warc.read_records(spark, archive).collect()
    assert len(got) == len(pages) and all(r.verified for r in got)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([(5, "revisit", 2), (2, "response", None), (2, "response", None), (9, "revisit", 2), (1, "response", None), (3, "response", None), (4, "response", None), (6, "response", None), (7, "revisit", 6), (None, "revisit", 2)])
    for r in got:
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert block == (bytes(r.payload) if r.record_type == "response" else b"") + b"\r\n\r\n" and size == len(block) - 4
        assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest and len(bytes(r.payload)) == r.payload_bytes
    assert archive.payloads(spark).count() == 4
    empty = warc.write_archive(df.limit(0), f"file://{tmp_path}/b")
    assert warc.read_records(spark, empty).count() == 0


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(160, 16))
    x[20:50] = x[20] + 0.15 * rng.normal(size=(30, 16))
    x[50:54] = x[50]
    data = [(i, [float(v) for v in row], i % 2 if i >= 54 else 0) for i, row in enumerate(x)]
    data += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] + [1.0] * 15, 0), (203, [float(v) for v in x[20]], None), (204, [], 0), (205, [None] * 16, 0), (206, [1.0, 2.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in data if i < 200]
    links = {i: {j for j, w, m in good if j != i and m == lab and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93} for i, v, lab in good}
    for i, *_ in good:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i] == (len(links[i]), min(seen), i == min(seen))
    assert all(got[i] == (0, i, True) for i in range(200, 207))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_jaccard_components(spark, docs, nothing, rows):
    got = jaccard.join(docs).collect()
    sets = {(r[0], r[1]): shingle_set(r[1]) for r in rows}
    keys = sorted(sets, key=repr)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k in keys:
        ids = [j[0] for j in keys if find(j) == find(k) and j[0] is not None]
        least[k] = k[0] if not sets[k] else min(ids, default=None)
    by_id = {k[0]: least[k] for k in keys}
    assert len(got) == len(rows) and all(r.component_id == by_id[r.doc_id] and r.n_shingles in {len(sets[k]) for k in keys if k[0] == r.doc_id} for r in got)
    assert jaccard.join(nothing).count() == 0
    left = jaccard.survivors(docs)
    assert left.columns == docs.columns and 1 not in {r.doc_id for r in left.collect()}


def test_jaccard_large_group_of_near_copies(spark):
    r = random.Random(8)
    base = prose(r, 150, 10**6).split()
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(3):
            w[r.randrange(150)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(r, 150, 10**6)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(300):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {x.doc_id: x.component_id for x in jaccard.join(df).collect()} == {i: find(i) for i in sets}


def test_fingerprints(docs, nothing, rows):
    got = fingerprint.fingerprints(docs).toPandas()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for a, b in zip(order, order[1:] + order[:1]):
        e = fingerprint.edited_text(a[1] or "", b[1] or "")
        want[a[0], len(a[1] or ""), hashlib.sha256(e.encode()).hexdigest()] += 1
    assert Counter((None if i != i else int(i), n, s) for i, n, s in zip(got.doc_id, got.n_chars, got.edited_sha256)) == want
    assert got[got.doc_id.isin([0, 2])].fingerprint.nunique() == 1
    assert fingerprint.fingerprints(nothing).count() == 0


def test_collision_rate_is_the_generalised_jaccard_similarity():
    v, rng, errors = fingerprint.variates(), np.random.default_rng(0), []
    for _ in range(200):
        a = rng.integers(0, 2**63, rng.integers(3, 200), dtype=np.uint64)
        wa = rng.choice([1, 1, 2, 5], len(a))
        wb = np.maximum(wa + rng.choice([-1, 0, 0, 2], len(a)), 1)
        keep = rng.random(len(a)) < rng.random()
        keep[0] = True
        j = np.minimum(wa, wb)[keep].sum() / (np.maximum(wa, wb)[keep].sum() + wa[~keep].sum())
        errors.append((v.signature(a, wa) == v.signature(a[keep], wb[keep])).mean() - j)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_repeats(docs, nothing, rows):
    got = repeats.remove(docs).toPandas()
    # rows of one id and text are one document; several texts of one id don't occur here
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = set(), {}
    for i, t in order:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = 1
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), int(gone.sum()), int(((gone[1:] == 0) & (gone[:-1] == 1)).sum()), hashlib.sha256(kept).hexdigest())
    assert len(got) == len(rows)
    for r in got.itertuples():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[None if r.doc_id != r.doc_id else int(r.doc_id)]
    assert repeats.remove(nothing).count() == 0


def test_merged_transforms_order_suffixes():
    r = random.Random(2)
    runs = [bytes(r.choice(b"ab") for _ in range(r.choice([100, 120, 140]))) for _ in range(6)]
    runs += [runs[0][:110] + b"zz", runs[1]]
    length = np.array([len(x) for x in runs])
    data = np.frombuffer(b"".join(runs), np.uint8)
    run = np.repeat(np.arange(len(runs)), length)
    inner = np.arange(len(data)) - (np.cumsum(length) - length)[run]
    shard = (run % 3).astype(np.uint16)
    left = length[run] - inner
    symbol = repeats.alphabet(data, left)
    by_shard = repeats.suffix_order(symbol, left, shard)
    merged, edge = repeats.merge(symbol, left, shard, inner < repeats.STEP, by_shard)
    assert sorted(merged.tolist()) == list(range(len(data)))
    raw = data.tobytes()
    whole = [p for p in merged.tolist() if left[p] >= 100]
    assert [raw[p : p + 100] for p in whole] == sorted(raw[p : p + 100] for p in whole)
    group = np.cumsum(edge)[[k for k, p in enumerate(merged.tolist()) if left[p] >= 100]]
    assert len(set(group.tolist())) == len({raw[p : p + 100] for p in whole})


def test_mixing(docs, nothing, rows):
    got, goal = mixing.plan(docs)
    pdf, goal = got.toPandas(), {r._src: r for r in goal.collect()}
    assert len(pdf) == len(rows)
    assert sorted(pdf["_tok"]) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
    for src, g in pdf.groupby(pdf.source.map(lambda s: "n" if s is None else "s" + s)):
        budget, longest = goal[src].budget, g["_tok"].max()
        assert budget - longest <= (g["_tok"] * g["copies"]).sum() <= budget
        assert goal[src].weight * pdf["_tok"].sum() <= mixing.MAX_REPEATS * g["_tok"].sum() + 1
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == pdf["copies"].sum() and mixing.mix(nothing).count() == 0


def test_mixing_exponent_meets_entropy(spark):
    t = spark.createDataFrame([("a", 700, 1), ("b", 200, 1), ("c", 100, 1)], "_src string, tokens long, n long")
    h = lambda a: dict((x, e) for x, e, _ in mixing._entropy_and_repeats(t, [a, 0.0, 1.0], 1000))
    a = mixing.exponent(t, 1000, 0.5, 100.0)
    assert abs(h(a)[a] - (h(a)[0.0] + h(a)[1.0]) / 2) < 1e-5
    assert mixing.exponent(t, 1000, 1.0, 1.5) > 0.3


def labelled(n, seed):
    r = random.Random(seed)
    texts, toxic, junk = [], [], []
    for i in range(n):
        t = prose(r, r.randrange(20, 80), 3000)
        bad, low = i % 5 == 0, i % 7 == 0
        if bad:
            t += " " + " ".join(r.choice(["grubnok", "flarzit", "mordwib"]) for _ in range(3))
        if low:
            t = re.sub(r"(\w+)", lambda m: m[1].upper() + "!!", t)
        texts.append(t), toxic.append(int(bad)), junk.append(int(low))
    return texts, np.array(toxic), np.array(junk)


def test_toxicity_on_held_out_texts():
    texts, toxic, _ = labelled(900, 1)
    ids = features.features(pa.array(texts))
    model = toxicity.fit(ids[:600], toxic[:600])
    p = model.score(ids[600:])
    assert ((p >= 0.7) == (toxic[600:] == 1)).mean() > 0.97
    assert (toxicity.fit(ids[:20], np.zeros(20, int)).score(ids[:5]) == 0).all() or toxicity.fit(ids[:20], np.zeros(20, int)).score(ids[:5]).max() < 1e-6
    assert toxicity.fit([], np.zeros(0, int)).score(ids[:2]).max() < 1e-6


def test_label_model_finds_bad_voters():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.3
    v = np.stack([np.where(rng.random(3000) < acc, np.where(y, 1, -1), np.where(y, -1, 1)) for acc in (0.9, 0.85, 0.8, 0.5)], 1)
    m = toxicity.fit_label_model(v, 0.3)
    acc = m.accuracies(v)
    assert acc[0] > acc[2] > acc[3] and ((m.posterior(v) > 0.5) == y).mean() > 0.88


def test_quality_on_held_out_texts(spark, docs, nothing):
    texts, toxic, junk = labelled(900, 2)
    ids = features.features(pa.array(texts))
    grades = np.where(junk == 1, 0, np.where(toxic == 1, 1, 2))
    m = quality.fit(ids[:600], grades[:600])
    assert m.thresholds[0] < m.thresholds[1]
    tails = m.tails(features.row_sums(ids[600:], m.weights, scaled=True))
    assert (tails[:, 0] >= tails[:, 1]).all() and ((tails[:, 0] >= 0.5) == (junk[600:] == 0)).mean() > 0.97
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.select(docs, labels).count() == docs.count()  # nothing rated: all stay
    rated = spark.createDataFrame([(0, 1, 0), (6, 0, 0), (6, 0, 0), (None, 1, 0), (9, None, 1)], labels.schema)
    assert quality.select(docs, rated).columns == docs.columns and quality.select(nothing, rated).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, rated)).count() == docs.count()
    assert toxicity.score(nothing, toxicity.train(nothing, rated)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rows = lambda p: sorted(map(tuple, p[sorted(p.columns)].astype(object).where(p[sorted(p.columns)].notna(), None).values.tolist()), key=repr)
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.sql(queries.ORACLES[name]).df())


def test_a_query_for_each_operator():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 13))
