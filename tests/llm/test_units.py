import pytest

from orbweaver.llm import units


def slow(rows, by, least):
    gap, seen, out = {"line": "\n", "paragraph": "\n\n"}[by], {}, {}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for doc, text in order:
        at, kept, gone = 0, [], []
        for u in (text.split(gap) if text is not None else []):
            norm = " ".join(u.lower().split())
            if norm and len(norm.split()) >= least and norm in seen:
                gone.append((at, len(u)))
            else:
                seen.setdefault(norm, doc)
                kept.append(u)
            at += len(u) + len(gap)
        out[doc] = (0 if text is None else len(text.split(gap)), len(gone), gone, gap.join(kept))
    return out


ROWS = [(3, "One line\nTwo  lines here\n\none LINE\nlast"), (1, "first\n two lines HERE \nx"), (2, None), (4, ""), (5, "two lines here"), (5, "two lines here"), (None, "first\nnew"), (6, "é à\n" * 3), (7, "many words in a line\n" * 20000)]


@pytest.mark.parametrize("by,least", [("line", 1), ("line", 3), ("paragraph", 1)])
def test_against_brute_force(spark, by, least):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, pos int, id string")
    got = units.dedup_units(df, by=by, min_words=least).collect()
    assert len(got) == len(ROWS)
    want = slow(ROWS, by, least)
    for r in got:
        assert (r.n_units, r.n_removed, [tuple(x) for x in r.removed], r.kept_text) == want[r.doc_id]


def test_empty(spark):
    assert units.dedup_units(spark.createDataFrame([], "doc_id long, text string")).count() == 0
