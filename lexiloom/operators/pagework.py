"""Work on the boxes of whole pages: sampling and rendering, fitting glyphs, readjusting, reconsidering, mapping text, batches.

A page's image and its boxes meet in one task (page_map), as every step depends on the one before; pages are independent. A font is
a dict of Glyph by (style, chr, var), aliases resolved, of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import images
from .boxes import NEWLINE, SPACE, UNKNOWN

#: Sizes that transforms are rounded up to; the default window of shifts is a share of them.
SIZES = (16, 20, 25, 32, 36, 40, 42, 44, 48, 50, 64, 66, 70, 72, 78, 80, 84, 90, 96, 100, 104, 108, 112, 120, 128, 130, 132, 140, 144, 150, 156, 160, 168, 180, 192, 200, 208, 210, 224, 240, 256, 260, 280, 300, 320, 324, 330, 336, 360, 384, 400, 416, 420, 432, 448, 450, 512)
#: Variants tried, the least correlation that moves a box, a paragraph's indent, and the correlation below which mapping stops.
VARIANTS, SNAP, INDENT, STOP = 20, 0.6, 93, 15
_SPLINE = np.array([[0, 2, 0, 0], [-1, 0, 1, 0], [2, -5, 4, -1], [-1, 3, -3, 1]]) / 2


@dataclass(frozen=True)
class Glyph:
    key: tuple[int, str, int]
    px: np.ndarray
    lb: float = 0.0
    rb: float = 0.0
    ld: float = 0.0
    rd: float = 0.0

    @property
    def size(self) -> tuple[int, int]:
        """Width and height."""
        return self.px.shape[1], self.px.shape[0]


Font = dict[tuple[int, str, int], Glyph]


def crop(ink: np.ndarray, l: int, t: int, r: int, b: int) -> np.ndarray:  # noqa: E741
    """A rectangle of an image; outside there is paper."""
    out = np.zeros((max(0, b - t), max(0, r - l)))
    x0, y0, x1, y1 = max(0, l), max(0, t), min(ink.shape[1], r), min(ink.shape[0], b)
    if x0 < x1 and y0 < y1:
        out[y0 - t : y1 - t, x0 - l : x1 - l] = ink[y0:y1, x0:x1]
    return out


def crop_bottom(ink: np.ndarray, height: int) -> np.ndarray:
    return ink[:height]


def sample(ink: np.ndarray, x: float, y: float) -> float:
    """Ink between pixels by a cubic spline of the 16 around, from 0 to 1."""
    u, v = int(np.floor(x)), int(np.floor(y))
    weights = lambda f: np.array([1, f, f * f, f**3]) @ _SPLINE
    return float(np.clip(weights(y - v) @ crop(ink, u - 1, v - 1, u + 3, v + 3) @ weights(x - u), 0, 1))


def render(ink: np.ndarray, mask: np.ndarray | None = None, zoom: int = 1) -> np.ndarray:
    """RGB bytes, one for zoom x zoom pixels: their mean as grey, or with a mask the colour of the pixel that differs most from it (white where
    both agree, recognised ink without scanned ink and scanned without recognised in two colours); red where mask ink piles up."""
    h, w = ink.shape[0] // zoom, ink.shape[1] // zoom
    tiles = lambda a: a[: h * zoom, : w * zoom].reshape(h, zoom, w, zoom).transpose(0, 2, 1, 3).reshape(h, w, -1)
    p = tiles(np.clip(ink, 0, 1))
    if mask is None:
        return np.repeat(((1 - p.mean(axis=2)) * 255).astype(np.uint8)[..., None], 3, axis=2)
    piled = tiles(np.maximum(mask, 0))
    m = np.minimum(piled, 1)
    at = np.square(p - m).argmax(axis=2)[..., None]
    p, m = (np.take_along_axis(a, at, 2)[..., 0] for a in (p, m))
    rgb = np.stack([1 - a * m * m - b * p * p + (a + b) * m * p for a, b in ((1.0, 1.0), (1.0, 0.7), (0.6, 1.0))], axis=2)
    out = (255 * np.clip(rgb, 0, 1)).astype(np.uint8)
    out[(piled > 1.5).any(axis=2)] = (255, 0, 0)
    return out


def fit(glyph: np.ndarray, area: np.ndarray, window: tuple[int, int, int, int] | None = None, good: float = 1.0) -> tuple[float, float, float]:
    """Correlation and shift (x, y) at which a glyph fits an area best. window: least and most x, then y, of the shift; good below 1
    takes the leftmost peak that reaches that share of the best."""
    (gh, gw), (ah, aw) = glyph.shape, area.shape
    up = lambda n: next((s for s in SIZES if s >= n), n)
    m, n = up(gw + aw), up(gh + ah)
    signed = 2 * glyph - 1
    norm = np.maximum(0, signed).sum() or 1.0
    values = np.zeros((n, m))
    got = images.correlate(np.pad(area, ((gh - 1, gh - 1), (gw - 1, gw - 1))), glyph) * norm
    values[: got.shape[0], : got.shape[1]] = got
    if window is None:
        x0, x1, y0, y1 = int(0.25 * m), int(0.75 * m), int(0.2 * n), int(0.8 * n)
    else:
        x0, x1, y0, y1 = max(0, window[0] + gw - 1), min(m, window[1] + gw - 1), max(0, window[2] + gh - 1), min(n, window[3] + gh - 1)
    part = values[y0:y1, x0:x1]
    if not part.size:
        return 0.0, 0.0, 0.0
    tops = part.max(axis=0)
    x = int(tops.argmax())
    if good < 1 and (tops > good * tops[x]).any():
        x = int((tops > good * tops[x]).argmax())
        while x + 1 < len(tops) and tops[x + 1] > tops[x]:
            x += 1
    y = int(part[:, x].argmax())
    best, x, y = float(part[y, x]), x + x0, y + y0
    if best <= 0:
        return best / norm, 0.0, 0.0

    def finer(low: float, high: float) -> float:
        return 0.5 * (high - low) / (best - min(low, high)) if best > min(low, high) else 0.0

    dx = finer(values[y, x - 1], values[y, (x + 1) % m])
    dy = finer(values[y - 1, x], values[(y + 1) % n, x])
    return best / norm, x - gw + 1 + dx, y - gh + 1 + dy


def _blank(chr_: str) -> bool:
    return chr_ in (SPACE, NEWLINE)


def _snapped(box: dict, glyph: Glyph, dx: float, dy: float) -> dict:
    left, top = box["l"] + round(dx), box["t"] + round(dy)
    return box | {"l": left, "t": top, "r": left + glyph.size[0], "b": top + glyph.size[1]}


def _area(ink: np.ndarray, box: dict) -> np.ndarray:
    return crop(ink, box["l"], box["t"], box["r"], box["b"])


def readjust(rows: list[dict], ink: np.ndarray, font: Font) -> list[dict]:
    """Every glyph takes its best variant, and its place where that fits well; spaces and line ends take theirs from the glyphs around."""
    out: list[dict] = []
    for box in rows:
        if not _blank(box["chr"]):
            tried = [(fit(font[k].px, _area(ink, box)), font[k]) for v in range(VARIANTS) if (k := (box["style"], box["chr"], v)) in font]
            corr = -1.0
            if tried:
                (corr, dx, dy), glyph = max(tried, key=lambda t: t[0][0])  # of equal ones the first
            if corr > SNAP:
                box = _snapped(box, glyph, dx, dy) | {"var": glyph.key[2]}
                corr = fit(glyph.px, _area(ink, box))[0]
            box = box | {"corr": int(100 * corr)}
        out.append(box)
    last = space = None
    for i, box in enumerate(out):
        if _blank(box["chr"]):
            if last and last["b"]:
                out[i] = box = box | {"l": last["r"], "r": last["r"] + 10, "t": last["t"], "b": last["b"]}
                last = last | {"r": box["r"]}
            space = i if box["chr"] == SPACE else space
        else:
            if space is not None:
                s = out[space]
                out[space] = s | {"r": box["l"], "t": max(s["t"], box["t"]), "b": min(s["b"], box["b"])}
            last, space = box, None
    return out


def _interpolated(x: int, line: list[dict]) -> int:
    """The top at x by the line's reliable boxes; without any the last box's."""
    good = [(b["corr"] / 100 * min(1.0, 10 / (b["l"] - x) ** 2 if b["l"] != x else 1.0), b["t"]) for b in line if b["chr"] != SPACE and b["corr"] > 60]
    total = sum(w for w, _ in good)
    return int(sum(w * t for w, t in good) / total) if total else (line[-1]["t"] if line else 0)


def reconsider(rows: list[dict], ink: np.ndarray, font: Font, confusables: dict[tuple, list[tuple]]) -> list[dict]:
    """Weak boxes move to the line's top, each box becomes the class of its confusable ones (itself first) that fits best, and spaces are set
    anew from bearings and deviations."""
    height = next(iter(font.values())).size[1] if font else 0
    rows, out, x_end, rdev, start = [dict(b) for b in rows], [], 0.0, 0.0, 0
    for i, box in enumerate(rows):
        if box["corr"] <= 60:
            end = next((k for k in range(start, len(rows)) if rows[k]["chr"] == NEWLINE), len(rows))
            box["t"] = _interpolated(box["l"], rows[start:end])
            box["b"] = box["t"] + height
        if box["chr"] == NEWLINE:
            x_end, start = 0.0, i + 1
            out.append(box)
            continue
        if box["chr"] == SPACE:
            continue
        own = (box["style"], box["chr"], box["var"])
        options = [font[k] for k in (own, *confusables.get(own, [])) if k in font]
        if not options:
            x_end = 0.0
            out.append(box)
            continue
        wide = max([box["r"] - box["l"], *(g.size[0] for g in options)])
        near = (-10, 10, -5, 5)
        glyph = max(options, key=lambda g: fit(g.px, _area(ink, box | {"r": box["l"] + wide}), near)[0])  # noqa: B023
        _, dx, dy = fit(glyph.px, _area(ink, box), near)
        box.update(_snapped(box, glyph, dx, dy), style=glyph.key[0], chr=glyph.key[1], var=glyph.key[2])
        box["corr"] = int(100 * fit(glyph.px, _area(ink, box), near)[0])
        if x_end > 0:
            gap, dev = box["l"] - (x_end + glyph.lb), rdev + glyph.ld
            if ((gap > 3 and gap > 10 * dev) or gap > 15) and box["l"] - x_end > 8:
                out.append(box | {"chr": SPACE, "style": 0, "var": 0, "corr": 0, "degenerate": False, "l": int(x_end), "r": box["l"]})
        x_end, rdev = box["l"] + glyph.rb, glyph.rd
        out.append(box)
    return out


def drop_weak(rows: list[dict], least: int = 0, punctuation: int = 0) -> list[dict]:
    """Glyphs of corr below least go, and commas and stops below punctuation."""
    return [b for b in rows if _blank(b["chr"]) or not (b["corr"] < least or (b["corr"] < punctuation and b["chr"] in (",", ".")))]


def drop_overlapping(rows: list[dict], font: Font) -> list[dict]:
    """Of neighbours that stand nearer than their bearings and deviations allow, the less likely one goes."""
    gone, i = set(), 0
    while i + 1 < len(rows):
        a, b = rows[i], rows[i + 1]
        keys = [(x["style"], x["chr"], x["var"]) for x in (a, b)]
        loser = None
        if not _blank(a["chr"]) and not _blank(b["chr"]) and all(k in font for k in keys):
            g, h = (font[k] for k in keys)
            err = b["l"] - (a["l"] + g.rb + h.lb) + g.rd + h.ld
            if err < -10:
                part = len(a["chr"]) > 1 and b["chr"] == a["chr"][-1]
                loser = i + 1 if a["corr"] >= b["corr"] or part or (a["chr"], b["chr"]) == ("—", "-") else i
            elif err < -5 or (err < -2 and a["chr"] != "-" and b["chr"] not in ("-", ",")):
                if a["corr"] > 85 and b["corr"] < 80:
                    loser = i + 1
                elif a["corr"] < 80 and b["corr"] > 85:
                    loser = i
            if loser is None and err < -15 and keys[0] == keys[1]:
                loser = i + 1
        gone |= {loser} - {None}
        i += 2 if loser == i + 1 else 1
    return [b for i, b in enumerate(rows) if i not in gone]


def fill_styles(rows: list[dict]) -> list[dict]:
    """White space has the style bits that it shares with the next glyph; the first row stays as it is."""
    out, right = list(rows), 0
    for i in range(len(out) - 1, 0, -1):
        if _blank(out[i]["chr"]):
            out[i] = out[i] | {"style": out[i]["style"] & right}
        else:
            right = out[i]["style"]
    return out


def resolve_styles(rows: list[dict], classes: dict[tuple, list[tuple]]) -> list[dict]:
    """In each token the alias variants with the fewest changes of style bits (ties: the smallest keys), then styles of white space."""
    out, best = list(rows), {}

    def settle(end: int) -> None:
        if best:
            cost, path = min(best.values())
            for k, (style, chr_, var) in enumerate(path):
                at = end - len(path) + k
                out[at] = out[at] | {"style": style, "chr": chr_, "var": var}
        best.clear()

    last = 0
    for i, box in enumerate([*rows, {"chr": NEWLINE, "style": 0, "var": 0}]):
        if _blank(box["chr"]):
            if best:
                settle(i)
                last = out[i - 1]["style"]
            if i < len(out):
                out[i] = out[i] | {"style": last}
            continue
        own = (box["style"], box["chr"], box["var"])
        options = sorted({own, *classes.get(own, [])})
        before = list(best.values())
        best.clear()
        for o in options:
            best[o] = min(((c + (p[-1][0] ^ o[0]).bit_count(), (*p, o)) for c, p in before), default=(0, (o,)))
    return fill_styles(out)


def batch(rows: list[dict], ink: np.ndarray, font: Font, confusables: dict[tuple, list[tuple]], classes: dict[tuple, list[tuple]]) -> list[dict]:
    """A page's whole clean-up, in the order of the workbench's batch."""
    rows = reconsider(readjust(rows, ink, font), ink, font, confusables)
    rows = resolve_styles(rows, classes)
    rows = drop_overlapping(drop_weak(rows, 0), font)
    rows = readjust(drop_weak(rows, 20, 40), ink, font)
    return resolve_styles(rows, classes)


def map_text(chars: list[tuple[str, int]], rows: list[dict], ink: np.ndarray, font: Font, spaces: tuple[float, float] = (10.0, 30.0), line: float = 60.0) -> list[dict]:
    """Boxes for a text of (character, style). Rows that still agree with the text are kept; from the first that doesn't, each glyph is
    sought where bearings and deviations expect it, until a found box is a later row again. Mapping stops at a fit below STOP."""
    longest = max((len(k[1]) for k in font), default=1)
    most = max((k[2] for k in font), default=0)
    out: list[dict] = []
    at, i, synced = 0, 0, True
    x = y = 0.0
    rdev, ydev, first, line_x, line_y = 50.0, 20.0, True, 0.0, 0.0

    def expected(k: int) -> list[Glyph]:
        found, text = {}, ""
        for j in range(k, min(k + longest + 1, len(chars))):
            if chars[j][1] != chars[k][1]:
                break
            text += chars[j][0]
            found |= {key: font[key] for v in range(most + 1) if (key := (chars[k][1], text, v)) in font}
        return [found[key] for key in sorted(found)]

    while at < len(chars):
        if synced:
            spelt = "\n" if i < len(rows) and rows[i]["chr"] == NEWLINE else rows[i]["chr"] if i < len(rows) else ""
            here = chars[at : at + len(spelt)]
            synced = bool(spelt) and [c for c, _ in here] == list(spelt) and all(s == rows[i]["style"] for _, s in here)
        if synced:
            box, i = dict(rows[i]), i + 1
            x, y = box["l"], box["t"]
        else:
            c, style = chars[at]
            box = {"chr": NEWLINE if c == "\n" else c, "style": style, "var": 0, "corr": 0, "degenerate": False}
            w, h = (10, 20) if c in " \n" else (30, 40)
            options = [] if c in " \n" else expected(at)
            best = -1.0
            for g in options:
                dx, (gw, gh) = rdev + g.ld, g.size
                left, top = int(x + g.lb - dx), int(y - ydev)
                area = crop(ink, left, top, left + int(2 * dx + gw), top + int(2 * ydev + gh))
                corr, sx, sy = fit(g.px, area, (-gw, int(2 * dx) + gw, 0, int(2 * ydev)), 0.7)
                if corr > best:
                    best, place, glyph = corr, (left + round(sx), top + round(sy)), g
            if options:
                (x, y), (w, h) = place, glyph.size
                box |= {"chr": glyph.key[1], "var": glyph.key[2], "corr": int(100 * best)}
            box |= {"l": int(x), "t": int(y), "r": int(x) + w, "b": int(y) + h}
            later = next((k for k in range(i, len(rows)) if all(rows[k][n] == box[n] for n in ("chr", "style", "var", "l", "t"))), None)
            if later is not None:
                box, i, synced = dict(rows[later]), later + 1, True
            elif options and box["corr"] < STOP:
                return [*out, box]
        out.append(box)
        if first and box["chr"] != NEWLINE:
            line_x, line_y, first = x, y, False
        if box["chr"] == SPACE:
            rdev = (spaces[1] - spaces[0]) / 2
            x += spaces[0] + rdev
        elif box["chr"] == NEWLINE:
            if first and line_x == x:  # an empty line: an indent follows
                x, line_y, first = x + INDENT, y, False
            else:
                x, y, rdev, ydev, first = line_x, line_y + line, 50.0, 20.0, True
        elif (g := font.get((box["style"], box["chr"], box["var"]))) is not None:
            x, rdev, ydev = x + g.rb, g.rd, 5.0
        else:
            x, rdev = x + 30, 30.0
        at += 1 if box["chr"] == NEWLINE else len(box["chr"])
    return out


def page_map(pages: DataFrame, boxes: DataFrame, key: str, work: Callable[[list[dict], np.ndarray], list[dict]]) -> DataFrame:
    """work over each page's boxes and image (key, width, px): a cogroup by page. Boxes are numbered anew from 1 in box_no."""
    schema = boxes.schema
    names = [c for c in schema.names if c not in (key, "box_no")]

    def run(page: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(page):
            return rows
        ink = np.asarray(page["px"].iloc[0], float).reshape(-1, int(page["width"].iloc[0]))
        out = work(rows.sort_values("box_no")[names].to_dict("records"), ink)
        made = pd.DataFrame([{c: b.get(c) for c in names} for b in out], columns=names)
        return made.assign(**{key: page[key].iloc[0], "box_no": range(1, len(out) + 1)})[schema.names]

    return pages.select(key, "width", "px").groupBy(key).cogroup(boxes.groupBy(key)).applyInPandas(run, schema)


def cluster_unknown(rows: list[dict], ink: np.ndarray, eps: float = 0.01) -> list[dict]:
    """Unknown boxes of like appearance (mean difference of features below eps, two or more) share a number as variant; 0 stands alone."""
    from .fonts import appearance

    at = [i for i, b in enumerate(rows) if b["chr"] == UNKNOWN]
    features = [appearance(_area(ink, rows[i]), (rows[i]["r"] - rows[i]["l"], rows[i]["b"] - rows[i]["t"])) for i in at]
    number, out = 0, list(rows)
    cluster = [0] * len(at)
    for k in range(len(at)):
        if cluster[k]:
            continue
        group, todo = [], [k]
        while todo:
            a = todo.pop()
            near = [b for b in range(len(at)) if not cluster[b] and b not in group and np.abs(features[a] - features[b]).mean() < eps]
            group += near
            todo += [b for b in near if b != a]
        if len(group) > 1:
            number += 1
            for b in group:
                cluster[b] = number
    for i, c in zip(at, cluster, strict=True):
        out[i] = out[i] | {"var": c}
    return out
