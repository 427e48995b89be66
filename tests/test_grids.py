"""Grids by work lists against plain passes, and words for holes against all rectangles."""

import random
import time

import pytest

from tetrad.functions.solver import solve
from tetrad.operators import grids


def passes(clusters, saturation):
    """Every pass tries every cluster that is left."""
    left, out = list(clusters), []
    while left:
        grid = grids.Grid(left.pop(0))
        out.append(grid)
        changed = True
        while changed:
            changed, rest = False, []
            for ratios in left:
                spot = grid.fit(ratios)
                trial = grid.copy()
                if spot:
                    trial.insert(ratios, *spot)
                if not spot or (saturation and trial.saturation() < saturation):
                    rest.append(ratios)
                    continue
                grid.cells, grid.at, grid.shape, changed = trial.cells, trial.at, trial.shape, True
            left = rest
    return out


def made(seed, n, stems, endings):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if r.random() < 0.5:
            x, y = r.sample(endings, 2)
            out.append([(s + x, s + y) for s in r.sample(stems, r.randint(2, 4))])
        else:
            x, y = r.sample(stems, 2)
            out.append([(x + e, y + e) for e in r.sample(endings, r.randint(2, 4))])
    return sorted(out, key=lambda c: (-len(c), c))


@pytest.mark.parametrize("saturation", [0.0, 0.5, 0.8])
@pytest.mark.parametrize("seed", range(12))
def test_work_lists_give_the_grids_of_passes(seed, saturation):
    clusters = made(seed, 60, ["ba", "di", "ku", "mo", "re", "sa", "ti"][: 4 + seed % 4], ["", "n", "nta", "s", "re", "k"])
    got, want = grids.assemble(clusters, saturation), passes(clusters, saturation)
    assert [(g.cells, g.at, g.shape) for g in got] == [(g.cells, g.at, g.shape) for g in want]


def test_a_long_chain_is_not_tried_again_and_again():
    """Each cluster fits only after the one behind it: passes would try all of them each time."""
    chain = [[(f"s{i}a", f"s{i}b"), (f"s{i + 1}a", f"s{i + 1}b")] for i in range(4000)]
    looked, fit = [0], grids.Grid.fit

    def counted(self, ratios):
        looked[0] += 1
        return fit(self, ratios)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(grids.Grid, "fit", counted)
        began = time.time()
        found = grids.assemble([chain[-1], *chain[:-1]])
    assert len(found) == 1 and len(found[0].at) == 2 * 4001
    assert looked[0] < 3 * len(chain) and time.time() - began < 20


def test_words_for_holes(spark, monkeypatch):
    r = random.Random(3)
    stems, endings = ["walk", "talk", "jump", "sing", "Xq"], ["", "s", "ed", "ing", "zz"]
    rows = [("g" if r0 < 4 else "h", i, j, s + e) for r0, (i, s) in enumerate(enumerate(stems)) for j, e in enumerate(endings) if r.random() < 0.6]
    rows += [("odd", i, j, w) for i, j, w in [(0, 0, "abc"), (0, 1, "x"), (1, 0, "y"), (2, 0, "q"), (2, 2, "qw"), (0, 2, "xw")]]
    cells = {(g, i, j): w for g, i, j, w in rows}
    want = []
    for g in {x[0] for x in rows}:
        tall, wide = max(i for x, i, _, _ in rows if x == g) + 1, max(j for x, _, j, _ in rows if x == g) + 1
        for i, j in ((i, j) for i in range(tall) for j in range(wide) if (g, i, j) not in cells):
            boxes = ((cells[g, k, m], cells[g, i, m], cells[g, k, j]) for k in range(tall) for m in range(wide) if {(g, k, m), (g, i, m), (g, k, j)} <= set(cells))
            word = next((w for w in (solve(*b) for b in boxes) if w is not None), None)
            want += [(g, i, j, word)] if word is not None else []
    df = spark.createDataFrame(rows, "grid_id string, row int, col int, word string")
    for tried in (64, 2):
        monkeypatch.setattr(grids, "TRIED", tried)
        assert sorted(map(tuple, grids.predictable_words(df).collect())) == sorted(want) and want
    assert grids.predictable_words(df.limit(0)).count() == 0
