"""License scans, whitening and the Merkle manifest against brute-force versions, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from marginalia.llm import licenses, merkle, queries, whitening

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return LICENSE_WORD.findall((text or "").translate(LOWER))


def notice(label, nth=0):
    return [t.text for t in licenses.TEMPLATES if t.label == label][nth]


def license_texts():
    rnd = random.Random(3)
    vocabulary = ["the", "License", "MIT", "CC", "by", "GNU", "general", "public", "apache", "version", "Ünï", "漢字", "7", "software"]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.choice([0, 2, 30, 300]))) for _ in range(60)]
    texts += ["MIT license MIT, License; mit-license", "CC BY CC BY-NC 4.0", "x gnu General\nPUBLIC (license)", "apache licenses", "ccby mit_license", "", None, "MİT license", "Apache\x00License"]
    return texts


def test_license_phrases_by_brute_force(spark):
    rows = list(enumerate(license_texts())) + [(3, "MIT License"), (3, "MIT License"), (None, "cc by")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, labels string, n_words int")
    got = sorted((tuple(r)[:6] for r in licenses.scan_licenses(df).collect()), key=repr)
    want = []
    for i, t in rows:
        w = words(t)
        places = [(s, label) for p, label in licenses.PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        starts = [s for s, _ in places]
        want.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    assert got == sorted(want, key=repr) and any(r[2] > 2 for r in want)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_license_notices(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    mit = notice("mit", 1).split()
    cases = [
        (notice("gpl-3.0"), "gpl,gpl-3.0", 1.0),
        (f"{filler} {notice('isc')} {filler}", "isc", 1.0),
        (f"{filler} {' '.join(mit[:20])} dear reader {' '.join(mit[20:])} {filler}", "mit", 1.0),  # words put in
        (" ".join(mit[:-4]), "mit", None),  # the end is missing
        (" ".join(mit[:12]), "", 0.0),  # too little of it
        (" ".join(w for w in mit if "restriction" not in w), "", 0.0),  # a key phrase is missing
        (" ".join(sorted(mit)), "", 0.0),  # its words, not its order
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0", 1.0),
        ("Released under the MIT License. " + notice("bsd"), "bsd,mit", 1.0),
        (filler, "", 0.0),
        (None, "", 0.0),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(df).collect()}
    for i, (_, labels, score) in enumerate(cases):
        assert got[i][0] == labels, i
        assert got[i][1] == score if score is not None else licenses.COVER <= got[i][1] < 1, i


def test_license_words_are_weighed_over_all_documents(spark):
    docs = spark.createDataFrame([("MIT mit",), ("the license",), ("the",), (None,)], "text string").repartition(3)
    assert licenses.document_frequencies(docs, {b"mit", b"the", b"gnu"}) == (4, {b"mit": 1, b"the": 2})
    index = licenses.Index((), licenses.PHRASES, 4, {b"mit": 1, b"license": 3})
    assert index.rank[b"mit"] < index.rank[b"license"] and index.rank[b"gnu"] < index.rank[b"mit"]


def test_license_votes_are_counted_by_different_words():
    """A candidate needs several of the rare words: one of them, however often, is none."""
    template = licenses.Template("t", "alpha beta gamma delta", ("delta",))
    index = licenses.Index((template,), (), 1, {})
    assert index.scan(b"alpha beta gamma delta")[3] == {"t": 1.0}
    assert index.scan(b"alpha " * 50 + b"x " * 50 + b"beta " * 50 + b"x " * 50 + b"gamma " * 50 + b"x " * 50 + b"delta")[3] == {}


def test_long_text_of_licenses(spark):
    text = "MIT License under version 2 of the license " * 400_000  # 17 MB, rare words everywhere
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_base"], r["last_word"]) == (3_200_000, 400_000, 3_199_992)


def vector_rows(rnd, d=20):
    a = rnd.standard_normal((300, d)) * np.linspace(1, 0.2, d)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(a.astype(np.float32))]
    rows += [(1000 + k, rows[k][1]) for k in range(40)] + [(5, rows[7][1]), (None, rows[8][1]), (900, rows[9][1]), (900, rows[9][1])]
    bad = [(2000, None), (2001, [float("nan")] + [0.0] * (d - 1)), (2002, [float("inf")] * d), (2003, [None] + [0.0] * (d - 1)), (2004, [])]
    return rows, bad


SCHEMA = "vec_id long, embedding array<float>, n string, whitened int"


def test_whitening_by_brute_force(spark):
    rows, bad = vector_rows(np.random.default_rng(1))
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows + bad], SCHEMA).repartition(5)
    got = whitening.whitened(df).toPandas()
    x = np.array([np.floor(256 * np.array(v, np.float32).astype(float)) for _, v in rows]).astype(int)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = fit - sums / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n}
    assert sorted(got[got["component"] == 2]["deviation"]) == sorted(((n * x - sums) ** 2).sum(1).tolist())
    want = (x - sums / n) @ vectors / np.sqrt(values)
    for k in range(4):
        own = got[got["component"] == k + 1]
        assert np.allclose(own["explained"], values[k] / np.trace(c.T @ c / n), rtol=1e-12)
        a, b = np.sort(own["whitened"].to_numpy()), np.sort(want[:, k])
        assert min(np.abs(a - b).max(), np.abs(np.sort(-own["whitened"].to_numpy()) - b).max()) < 1e-9
        signs = {np.sign(own[own["vec_id"] == i]["whitened"].iloc[0] * want[[r[0] for r in rows].index(i), k]) for i in range(100, 300)}
        assert len(signs) == 1
    assert set(got["identity_error"]) == {got["identity_error"][0]} and got["identity_error"][0] < 1e-9


def test_whitening_of_close_eigenvalues(spark):
    """Vectors without a preferred direction: wanted and unwanted eigenvalues lie close together."""
    a = np.random.default_rng(5).standard_normal((3000, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "vec_id long, embedding array<double>").repartition(4)
    got = whitening.whitened(df).toPandas().sort_values(["component", "vec_id"])
    x = np.floor(256 * a)
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / len(c))
    for k in range(4):
        own, want = got[got["component"] == k + 1], c @ vectors[:, -1 - k] / np.sqrt(values[-1 - k])
        sign = np.sign(own["whitened"].iloc[0] * want[0])
        assert np.abs(own["whitened"].to_numpy() - sign * want).max() < 1e-8
        assert abs(own["explained"].iloc[0] - values[-1 - k] / values.sum()) < 1e-12


def test_whitening_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whitened(frame([])).count() == 0 and whitening.whitened(frame([(1, None), (2, [])])).count() == 0
    one = whitening.whitened(frame([(1, [0.5, -0.5]), (2, [0.5, -0.5])])).collect()  # no variance
    assert len(one) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"]) == (1, 0, None, 0.0) for r in one)
    lengths = whitening.whitened(frame([(1, [0.25]), (2, [0.75]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 0.0, 1.0])])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in lengths) == [(1, 1), (2, 1)] + [(i, k) for i in (3, 4, 5) for k in (1, 2, 3)]
    assert {round(abs(r["whitened"]), 9) for r in lengths if r["vec_id"] < 3} == {1.0}
    assert all(r["whitened"] is None for r in lengths if r["vec_id"] >= 3 and r["component"] == 3)
    far = whitening.whitened(frame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])])).collect()
    assert {(r["vec_id"], r["whitened"] is None, r["n"]) for r in far if r["component"] == 1} == {(1, True, 2), (2, False, 2), (3, False, 2)}


def test_deviation_is_exact_or_null():
    x = np.array([[3, -4], [1 << 20, 5], [(1 << 31) - 1, 7]])
    sums = np.array([11, 1 << 40])
    got = whitening._deviation(x, 1 << 11, sums)
    want = [sum(((1 << 11) * int(c) - int(s)) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    assert got == [w if w < 1 << 63 else None for w in want]
    assert whitening._deviation(np.array([[3, -4]]), 5, np.array([1, 2])) == [(15 - 1) ** 2 + (-20 - 2) ** 2]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        levels.append(nodes)
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
        i //= 16
    return out


def brute_manifest(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([leaf_of(r) for r in sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))]) for s in sources}
    above = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for r in rows:
        t = trees[r[1]]
        path = siblings(t, t[0].index(leaf_of(r))) + siblings(above, sources.index(r[1]))
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        h = leaf_of((*r[:4], r[4] if r[4] is None else r[4].translate(LOWER))) if changed else leaf_of(r)
        for d, side in path:
            h = sha("".join([*side[:d], h, *side[d:]]))
        out.append((r[0], leaf_of(r), t[-1][0], above[-1][0], sha("".join(x for _, side in path for x in side)), h, h == above[-1][0]))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, rank int"


def document_rows(rnd):
    rows = []
    for source, n in ((None, 3), ("", 1), ("a", 16), ("b", 17), ("é", 1), ("Z", 2), ("hot", 700)):
        rows += [(len(rows) * 7 % 5003 + k, source, rnd.choice(["en", None]), rnd.choice([None, k]), rnd.choice([f"Text {k}", "", None, "ÄÖ x", "lower"])) for k in range(n)]
    rows += [(10_000 + k, f"s{k:03}", "en", 1, f"T{k}") for k in range(30)]
    return rows + [(None, "a", "en", 3, "No Id"), rows[5], rows[5], (rows[5][0], "a", "en", 3, "same id")]


def test_merkle_by_brute_force(spark):
    rows = document_rows(random.Random(8))
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS).repartition(3)
    found = merkle.verified_manifest(df)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = brute_manifest(rows)
    assert got == want and {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_merkle_of_one_source(spark, n):
    rows = [(k, "s", None, None, f"T {k}") for k in range(n)]
    got = merkle.verified_manifest(spark.createDataFrame([(*r, "", 0) for r in rows], DOCS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(rows)
    if n == 1:
        assert got[0]["root"] == got[0]["leaf"] and got[0]["proof_sha256"] == sha("")


def test_merkle_proves_some_leaves(spark):
    """Requests for a few leaves descend to those only; their proofs are those of the whole."""
    rows = document_rows(random.Random(9))
    df = spark.createDataFrame([(*r, "", 0) for r in rows], DOCS)
    leaves = df.select(merkle.F.col("source").alias("group"), "doc_id", merkle.leaf_digest(*[merkle.F.col(c) for c in merkle.FIELDS]).alias("digest"))
    m = merkle.build_manifest(leaves, "doc_id")
    some = m.leaves.where("doc_id % 50 = 1 or tree = 's'")
    got = sorted((r["doc_id"], r["digest"], r["p"], r["f"]) for r in merkle.prove(m, some).select("doc_id", "digest", merkle.proof_digest(merkle.F.col("path")).alias("p"), merkle.folded(merkle.F.col("digest"), merkle.F.col("path")).alias("f")).collect())
    want = {(r[0], r[1]): (r[4], r[3]) for r in brute_manifest(rows)}
    assert len(got) == some.count() > 3 and all(want[i, d] == (p, f) for i, d, p, f in got)


def test_merkle_long_text(spark):
    rows = [(1, "s", "en", 5, "Ab " * 7_000_000), (2, "s", "en", 5, "x")]
    got = merkle.verified_manifest(spark.createDataFrame([(*r, "", 0) for r in rows], DOCS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(rows)


def test_queries_of_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    assert sorted((tuple(r) for r in queries.op13_merkle(spark, SF).collect()), key=repr) == brute_manifest(rows)
    assert queries.op11_licenses(spark, SF).count() == len(rows)
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert queries.op12_whitening(spark, SF).count() == 4 * vectors
