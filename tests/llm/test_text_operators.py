"""License scan, language, toxicity, decontamination."""

import itertools
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from cartolith.llm import decontaminate, language, licenses, queries, toxicity, words


def test_license_scan(docs_of, odd_rows):
    gpl = "Gnu  General, PUBLIC license"
    notice = " ".join(w.upper() for w in licenses.tokens(licenses.TEMPLATES["mit permission"][1])[::-1][:-3])
    rows = odd_rows + [(20, f"{gpl}\nthe MIT License; cc-by"), (21, "cc bys mit licenses xcc by"), (22, f"x {notice} y"), (23, notice.replace(" ", "\n")), (24, "mit license mit license")]
    found = {r.doc_id: r for r in licenses.scan(docs_of(rows)).collect()}
    assert len(licenses.scan(docs_of(rows)).collect()) == len(rows)
    for i, t in rows:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = [(k, label) for k in range(len(ws)) for p, label in licenses.PHRASES.items() if ws[k:k + len(p.split())] == p.split()]
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None)), t
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert "mit" in found[22].labels and found[22].score >= 0.8 and found[23].score == 0
    assert licenses.scan(docs_of([])).collect() == []


def test_license_join_is_exact(docs_of):
    """All blocks over the threshold, by trying every block with every template."""
    rnd = random.Random(3)
    templates = {f"t{k}": ("l", " ".join(rnd.sample([f"v{i}" for i in range(14)], rnd.randint(2, 10)))) for k in range(6)}
    rows = [(i, "\n".join(" ".join(rnd.choice([f"v{j}" for j in range(16)]) for _ in range(rnd.randint(0, 25))) for _ in range(3))) for i in range(60)]
    base = docs_of(rows).select("doc_id", "text", F.lit(0).cast("long").alias("key"))
    for threshold in (0.5, 0.8, 1.0):
        found = {(r.doc_id, r.block, r.template, r.containment) for r in licenses.blocks_found(base, templates, threshold).collect()}
        want = set()
        for i, t in rows:
            for b, line in enumerate(t.split("\n")):
                for name, (_, x) in templates.items():
                    share = len(set(line.split()) & set(x.split())) / len(set(x.split()))
                    if share >= threshold:
                        want.add((i, b, name, share))
        assert found == want


def test_wrapped_licenses(spark, docs_of, odd_rows, tmp_path):
    """License sentences over several lines, by trying every window; what lines give stays."""
    rnd = random.Random(5)
    rows = list(odd_rows)
    for k, (label, text) in enumerate(licenses.TEMPLATES.values()):
        w = text.split()
        for width in (3, 7):
            lines = "\n# ".join(" ".join(w[i:i + width]) for i in range(0, len(w), width))
            rows.append((100 + 10 * k + width, " ".join(rnd.choice(["one", "the", "of\n"]) for _ in range(rnd.randint(0, 40))) + f"\n# {lines}\nrest of it"))
    rows.append((300, "\n".join(rnd.sample([w for _, t in licenses.TEMPLATES.values() for w in t.split()] * 3, 300))))
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op2_license_scan(spark, str(tmp_path)).collect()}
    by_line = {r.doc_id: r for r in licenses.scan(docs_of(rows)).collect()}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    for i, t in rows:
        best, labels = 0, set(filter(None, by_line[i].base_labels.split(",")))
        ws = cut(t or "")
        for name, (label, x) in licenses.TEMPLATES.items():
            n, own = len(cut(x)), set(cut(x))
            need, others = licenses.NAMES.get(name, ((), ()))
            tried = [ws[k:k + 2 * n] for k in range(0, max(len(ws), 1), n)] + [line for line in map(cut, (t or "").split("\n")) if len(line) <= 2 * n]
            share = max((len(own & set(b)) / len(own) for b in tried if set(need) <= set(b) and not set(others) & set(b)), default=0)
            if share >= licenses.THRESHOLD:
                best, labels = max(best, share), labels | {label}
        assert (found[i].score, found[i].labels) == (best, ",".join(sorted(labels))), t
    for k, (label, _) in enumerate(licenses.TEMPLATES.values()):
        for width in (3, 7):
            assert found[100 + 10 * k + width].score == 1 and label in found[100 + 10 * k + width].labels.split(",")


def test_sentences_of_other_licenses(docs_of):
    """Sentences that share most words with a template of another license."""
    gpl = licenses.TEMPLATES["gpl notice"][1]
    probes = {1: ("The album was released under the license of the studio", ""), 2: ("Released under the BSD License", ""), 3: ("Licensed under the MIT License, Version 2.0", "mit"), 4: ("Licensed under CC BY-SA 4.0", "cc-by"),
              5: ("Licensed under CC BY-NC-ND 4.0", "cc-by"), 6: (gpl.replace("General", "Lesser General"), ""), 7: (" ".join(["released"] + ["word"] * 900 + ["the"] + ["thing"] * 900 + ["mit under"] + ["other"] * 900 + ["license"]), ""),
              8: (gpl, "gpl"), 9: ("Released under the MIT License", "mit"), 10: ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc")}
    found = {r.doc_id: r.labels for r in licenses.scan(docs_of([(i, t) for i, (t, _) in probes.items()]), wrapped=True).collect()}
    assert found == {i: x for i, (_, x) in probes.items()}


def test_words_are_cut_and_told_apart():
    import pyarrow as pa
    texts = ["", "one two", "  ONE,two  ", "é ß", "x", " ", "a" * 5000 + " b"] * 3
    column = pa.array(["skipped", *texts]).slice(1)
    for kind, pattern in ((words.ALNUM, r"[0-9A-Za-z\x80-\U0010ffff]+"), (words.NOT_SPACE, r"[^\x20\x09-\x0D]+")):
        seen, got = {}, []
        for row, offsets, data in words.parts(column, 6000):
            w = words.words(offsets, data, kind)
            for i in range(len(offsets) - 1):
                lo, hi = w.first[i], w.first[i + 1]
                assert (w.doc[lo:hi] == i).all()
                own = [bytes(data[a:b]).decode().lower() for a, b in zip(w.start[lo:hi], w.end[lo:hi])]
                got.append(own)
                for x, h in zip(own, w.hash[lo:hi].tolist()):
                    assert seen.setdefault(x, h) == h
        assert got == [[x.lower() for x in re.findall(pattern, t)] for t in texts]
        assert len(set(seen.values())) == len(seen)


def test_language(spark, sf, docs_of, odd_rows):
    found = queries.op3_language_id(spark, sf).alias("f").join(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("i"), "lang"), F.col("doc_id") == F.col("i")).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    rows = [(*r, "xx") for r in odd_rows] + [(50 + i, "der die das und", "de") for i in range(9)] + [(70 + i, "the of and to", None) for i in range(3)]
    some = {r.doc_id: r for r in language.identify(docs_of(rows)).collect()}
    assert {some[i].lang_pred for i in (1, 2, 3, 10)} == {"und"} and some[51].lang_pred == "de"
    assert language.identify(docs_of([])).collect() == []
    assert {r.lang_pred for r in language.identify(docs_of([(1, "abc", None)])).collect()} == {"und"}


def test_vectors_are_bound_and_bundled():
    """The kernel against a plain sum over trigrams."""
    base = language.letters(64, 1)
    text = "Abc abc ñandú"
    codes, n = np.unique(language.trigrams(text), return_counts=True)
    plain = np.zeros(64)
    table = language.symbol_table()
    s = [0, *(int(table[ord(c)]) for c in text.lower()), 0]
    for a, b, c in zip(s, s[1:], s[2:]):
        plain += np.roll(base[a], 2) * np.roll(base[b], 1).astype(int) * base[c]
    assert (language.bundle(codes, n[None, :].astype(float), base, block=3)[0] == plain).all()


def test_toxicity(spark, sf, docs_of, odd_rows):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = queries.op7_toxicity_chain(spark, sf).collect()
    assert len(found) == docs.count() and all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in found)
    none = labels.where("false")
    assert not any(r.toxic for r in toxicity.judge(docs_of(odd_rows), none).collect())
    assert toxicity.judge(docs_of([]), labels).collect() == []
    nulls = spark.createDataFrame([(1, None, 1), (2, 1, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(toxicity.judge(docs_of(odd_rows), nulls).collect()) == len(odd_rows)


def test_toxicity_on_unseen_documents(spark, docs_of):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id"), "doc_id")
    odd = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 1
    found = toxicity.judge(docs, labels.where(odd)).withColumnRenamed("toxic", "said").join(labels.where(~odd), "doc_id")
    r = found.agg(F.sum(F.expr("int(said and toxic = 1)")).alias("hit"), F.sum(F.expr("int(said)")).alias("said"), F.sum("toxic").alias("toxic"), F.sum(F.expr("int(said and toxic = 0)")).alias("wrong")).first()
    assert r.hit >= 0.85 * r.toxic and r.wrong <= 0.05 * r.said   # some labels are wrong on purpose


def test_chain_feeds_earlier_probabilities(spark, docs_of):
    """The second category is the first one and nothing else, so its model must lean on the first probability."""
    rows = [(i, ("bad " if i % 3 == 0 else "good ") * 3 + f"w{i % 17}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, a int")
    models = toxicity.learn(docs_of(rows), labels, {"first": F.col("a") == 1, "second": F.col("a") == 1})
    assert len(models[0].weights) == len(models[0].chosen) + 1 and len(models[1].weights) == len(models[1].chosen) + 2 and models[1].weights[-2] > 0
    found = {r.doc_id: r for r in toxicity.score(docs_of(rows), models, ["first", "second"]).collect()}
    assert all((found[i].p_second > 0.5) == (i % 3 == 0) for i, _ in rows)


def brute_overlap(doc, item):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    d, b = cut(doc), cut(item)
    size = min(decontaminate.WINDOW, len(b))
    if len(b) < decontaminate.MIN_WORDS:
        return 0.0
    best = 0
    for i in range(len(d) - size + 1):
        for j in range(len(b) - size + 1):
            best = max(best, sum(x == y for x, y in zip(d[i:i + size], b[j:j + size])))
    if best >= decontaminate.SHARE * size:
        return best / size
    ends = range(-len(b), len(d)) if len(d) < size else [*range(-len(b), size - len(b)), *range(len(d) - size, len(d))]
    for shift in ends:           # the document begins or ends inside the item
        lo, hi = max(0, -shift), min(len(b), len(d) - shift)
        if hi - lo < size and any(d[i + shift:i + shift + decontaminate.EDGE] == b[i:i + decontaminate.EDGE] for i in range(lo, hi - decontaminate.EDGE + 1)):
            return 1.0
    return 0.0


def test_cut_by_the_documents_edge(spark, docs_of):
    item = [f"w{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "only four words here"), (3, "x"), (4, " ".join(f"v{i}" for i in range(14)))], "item_id long, text string")
    rows = [(1, " ".join(item[:15])), (2, "other words stand before it " + " ".join(item[:15])), (3, " ".join(item[4:18])), (4, " ".join(item[7:]) + " then more words follow here"), (5, " ".join(item[:12])),
            (6, "a text with Only, four; words HERE in it"), (7, "y x z"), (8, "only four words"), (9, " ".join(f"v{i}" for i in range(1, 14))), (10, " ".join(f"v{i}" for i in range(2, 14))), (11, " ".join([*item[:14], "z"]))]
    got = {r.doc_id: r.contaminated for r in decontaminate.contaminated(docs_of(rows), bench).collect()}
    want = {i: any(brute_overlap(t, b) for b in (" ".join(item), "only four words here", "x", " ".join(f"v{i}" for i in range(14)))) for i, t in rows}
    assert got == want == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 8: False, 9: True, 10: False, 11: True}


def test_masks_miss_no_window():
    """Whatever a fifth of the words of a window are substituted, some mask stands on equal words."""
    for size in range(9, 17):
        shapes = [s for _, s, _ in decontaminate.shapes_for([size])]
        for bad in itertools.combinations(range(size), size // 5):
            assert any(all(at + i not in bad for i in s) for s in shapes for at in range(size - s[-1]))


def test_decontamination(spark, docs_of, odd_rows):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = {k: text(n) for k, n in enumerate([40, 60, 16, 15, 12, 10, 9, 6, 5, 3, 0])}
    rows = list(odd_rows)
    for i in range(120):
        w = text(rnd.randint(0, 80))
        if rnd.random() < 0.6:
            b = list(items[rnd.randrange(len(items))])
            lo = rnd.randrange(len(b) - 15) if len(b) > 16 and rnd.random() < 0.5 else 0
            b = b[lo:lo + 24]
            for _ in range(rnd.randint(0, 4)):
                if b and len(b) >= 9:
                    b[rnd.randrange(len(b))] = "zz"
            w = w[:20] + b + w[20:]
        rows.append((100 + i, ", ".join(w).upper()))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(99, None), (None, " ".join(items[0]))], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contaminated(docs_of(rows), bench).collect()}
    assert len(found) == len({i for i, _ in rows})
    for i, t in rows:
        each = {k: brute_overlap(t, " ".join(w)) for k, w in items.items()}
        hits = {k: v for k, v in each.items() if v}
        r = found[i]
        assert (r.contaminated, r.n_items, r.overlap) == (bool(hits), len(hits), max(hits.values(), default=0.0)), (i, t, each)
        assert r.item_id == (min(k for k, v in hits.items() if v == r.overlap) if hits else None)
    assert sum(r.contaminated for r in found.values()) > 20
    assert decontaminate.contaminated(docs_of([]), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.contaminated(docs_of(odd_rows), bench.where("false")).collect())
