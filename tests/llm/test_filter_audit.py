import itertools
import re

from cardloom.llm import filter_audit as fa


def plain_audit(docs, labels):
    """Rows of the audit by applying every order to every document."""
    firsts = {}
    for i, text, _ in docs:
        if i is not None:
            firsts[text or ""] = min(firsts.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    parts = {}
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > firsts[text],
        }
        parts.setdefault(part or "", []).append((i, {f for f, x in fails.items() if x}))
    out, shapley = [], {}
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [i for i, fails in rows if f in fails and not fails & before]
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
                kept = sum(not fails & (before | {f}) for _, fails in rows)
                redundant = sum(f in fails and bool(fails & before) for _, fails in rows)
                alone = sum(fails == {f} for _, fails in rows)
                out.append((part, "".join(order), step, kept, len(here), redundant, alone, sum(i in good for i in here), sum(i in toxic for i in here)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_orders_come_by_single_swaps():
    for size in range(1, 6):
        order, seen = list(range(size)), [tuple(range(size))]
        for k in fa.plain_changes(size):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(size)))


def test_audit_is_that_of_all_orders_on_all_documents(spark):
    many = " ".join(f"w{i}" for i in range(60))
    docs = [(1, many, "a"), (2, many, "a"), (2, many, "a"), (3, many, "b"), (4, many + " $", None), (5, "X " * 70, "a"), (6, None, ""), (7, "", "b"), (None, many, "a"), (None, many, "a")]
    docs += [(1, many, "a"), (8, "é " * 80, "b"), (9, "A" * 10, "b"), (9, "another #", "c"), (10, many + " É", "c"), (-3, "X " * 70, "c")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, None, 1), (9, 1, 1), (None, 1, 1), (77, 1, 1)]
    rows = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id bigint, text string, source string, mask int, digest string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = sorted(map(tuple, fa.audit(fa.cells(rows, marks)).collect()))
    assert got == plain_audit(docs, labels)
    assert len(got) == 600 * 4
    assert fa.audit(fa.cells(rows.limit(0), marks)).count() == 0


def test_shapley_sums_share_out_all_that_goes(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    rows = fa.op13_filter_audit(spark, "/root/testdata/sf0.001").toPandas()
    last = rows[rows.step == 5]
    gone = rows.groupby("filter_order").removed.sum()
    assert (gone + last.groupby("filter_order").kept.sum() == read("documents").count()).all()
    one = rows[rows.filter_order == "ABCDE"]
    assert one.shapley.sum() == 120 * one.removed.sum()
