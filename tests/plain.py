"""Rules of the library stated in plain Python, character by character, for tests to hold it against."""

from __future__ import annotations

from marginalia.functions.text import LIGATURES, SOFT_HYPHEN
from marginalia.operators.quads import FAR


def normal_with_map(text: str) -> tuple[str, list[int]]:
    """The page normaliser's result and, for each of its characters, the place in the original that it comes from."""
    out: list[str] = []
    at: list[int] = []
    i, n = 0, len(text)
    pending = -1  # a white space run that becomes one space if something follows
    while i < n:
        c = text[i]
        kept = c == "-" and text[i + 1 : i + 3] == SOFT_HYPHEN + "\n"
        if kept and (rest := text[i + 3 :].lstrip(SOFT_HYPHEN))[:1] == "\n":
            i = n - len(rest) + 1
            continue
        if kept:
            width, letter = 3, "-"
        elif c == SOFT_HYPHEN:
            i += 1
            continue
        elif c == "-" and (rest := text[i + 1 :].lstrip(SOFT_HYPHEN))[:1] == "\n":
            i = n - len(rest) + 1
            continue
        elif c.isspace():
            if out and pending < 0:
                pending = i
            i += 1
            continue
        else:
            k = LIGATURES.find(c)
            width, letter = 1, c if k < 0 else ("f" if k < 5 else "s")
        if pending >= 0:
            out.append(" ")
            at.append(pending)
            pending = -1
        out.append(letter)
        at.append(i)
        i += width
    return "".join(out), at


def flat_with_map(text: str) -> tuple[str, list[int]]:
    """A text with its white space collapsed and, for each character, the place in the original that it comes from."""
    out: list[str] = []
    at: list[int] = []
    pending = -1
    for i, c in enumerate(text):
        if c.isspace():
            if out and pending < 0:
                pending = i
            continue
        if pending >= 0:
            out.append(" ")
            at.append(pending)
            pending = -1
        out.append(c)
        at.append(i)
    return "".join(out), at


def letters_with_map(text: str) -> tuple[str, list[int]]:
    """Letters and digits in lower case, and where each comes from; a hyphen takes one mark or space after it along."""
    out, at, skip = "", [], False
    for i, c in enumerate(_lower(text)):
        if c == "-":
            skip = True
        elif c.isalnum():
            out, skip = out + c, False
            at.append(i)
        elif skip:
            skip = False
        elif out and out[-1] != " ":
            out += " "
            at.append(i)
    return out.rstrip(), at[: len(out.rstrip())]


def _lower(text: str) -> str:
    """Lower case of the same length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def occurrences(phrase: str, text: str, at: list[int]) -> list[tuple[int, int, bool]]:
    """Original places (start, end) of a phrase in a text with a map, and whether they begin and end with whole words of that text."""
    out = []
    i = text.find(phrase) if phrase else -1
    while i >= 0:
        j = i + len(phrase)
        whole = not (i and text[i - 1].isalnum() and text[i].isalnum()) and not (j < len(text) and text[j].isalnum() and text[j - 1].isalnum())
        out.append((at[i], at[j - 1] + 1, whole))
        i = text.find(phrase, i + 1)
    return out


def match_places(text: str, strategy: str, norm: str, variants: list[str]) -> list[tuple[int, int]]:
    """Places (start, end) in a page's text of what a strategy of ``matching.match`` found there.

    An anchored text is where its anchor first stands. Others are sought case apart in the page's normal form, and exact
    and prefix texts also by the first of their spellings that the page itself holds. Of several places those that begin and
    end with whole words go first (a word parted at a line's end is one word); only where there is none do parts of words count.
    """
    page, at = normal_with_map(text)
    if strategy == "anchored":
        return [(s, e) for s, e, _ in occurrences(norm, page, at)[:1]]
    found = occurrences(_lower(norm), _lower(page), at)
    if strategy != "normalised":
        flat, at = flat_with_map(text)
        flat = _lower(flat)
        found += next((p for v in variants if (p := occurrences(_lower(v), flat, at))), [])
    return sorted({(s, e) for s, e, whole in found if whole} or {(s, e) for s, e, _ in found})


def page_with_boxes(words):
    """(text, [(ord, box) or None for each character]) of words (ord, block, line, x0, y0, x1, y1, word), a word's box dealt evenly."""
    by_line = {}
    for w in words:
        by_line.setdefault(w[1:3], []).append(w)
    text, boxes = "", []
    for n, line in enumerate(sorted(by_line.values(), key=lambda ws: (min(w[0] for w in ws), ws[0][1:3]))):
        for k, (ord_, _, _, x0, y0, x1, y1, word) in enumerate(sorted(line)):
            if n or k:
                text += "\n" if not k else " "
                boxes.append(None)
            side = lambda i, x0=x0, x1=x1, word=word: x1 if i == len(word) else x0 + i * (x1 - x0) / len(word)
            text += word
            boxes += [(ord_, (side(i), y0, side(i + 1), y1)) for i in range(len(word))]
    return text, boxes


def line_rects(text, boxes, start, end, tolerance=5.0):
    out, now, y = [], None, None
    for c, b in zip(text[start:end], boxes[start:end], strict=True):
        if c == "\n":
            out += [now] if now else []
            now = y = None
        elif b:
            x0, y0, x1, y1 = b[1]
            if now is None or (y is not None and abs(y0 - y) >= tolerance):
                out += [now] if now else []
                now, y = (x0, y0, x1, y1), y0
            else:
                now = (min(now[0], x0), min(now[1], y0), max(now[2], x1), max(now[3], y1))
    return out + ([now] if now else [])


def first_fit(rects: list, fits, grows: bool = True) -> list[list[int]]:
    """Groups of places: each rect joins the first group it fits. ``fits`` sees the group's box, or each of its members."""
    groups: list[list[int]] = []
    boxes: list[list[float]] = []
    for i, r in enumerate(rects):
        for g, b in zip(groups, boxes, strict=True):
            if fits(r, b) if grows else any(fits(r, rects[j]) for j in g):
                g.append(i)
                b[:] = [min(b[0], r[0]), min(b[1], r[1]), max(b[2], r[2]), max(b[3], r[3])]
                break
        else:
            groups.append([i])
            boxes.append(list(r))
    return groups


def same_passage(r, c) -> bool:
    """Beside a group on its line, or on the line below it with overlapping x."""
    beside = abs(r[1] - c[1]) < 3 and (abs(r[0] - c[2]) < 5 or abs(r[2] - c[0]) < 5)
    below = abs(r[1] - c[3]) <= 25 and not (r[2] < c[0] - 10 or r[0] > c[2] + 10)
    return beside or below


def near_place(rects: list, x: float, y: float) -> list[int]:
    """Places of the rects of the passage nearest to a point, then those of others beside it and not far."""
    groups = first_fit(rects, same_passage)
    boxes = [(min(rects[i][0] for i in g), min(rects[i][1] for i in g), max(rects[i][2] for i in g), max(rects[i][3] for i in g)) for g in groups]
    far = [((b[0] - x) ** 2 + (b[1] - y) ** 2) ** 0.5 for b in boxes]
    best = min(range(len(groups)), key=lambda k: (far[k], k))
    level = [k for k in range(len(groups)) if k != best and far[k] < FAR and not (boxes[k][3] < boxes[best][1] or boxes[k][1] > boxes[best][3])]
    return [i for k in (best, *level) for i in groups[k]]


def connected(a, b, across: float = 50.0, down: float = 25.0) -> bool:
    """Same height and a small gap across, or same columns and a small gap down."""
    gap_x, gap_y = max(a[0], b[0]) - min(a[2], b[2]), max(a[1], b[1]) - min(a[3], b[3])
    return (gap_y <= 0 and gap_x < across) or (gap_y < down and gap_x <= 0)


def take_nearest(hx, hy, cx, cy) -> list[int | None]:
    """For each highlight in turn the nearest clipping still free, the first of equals."""
    free = list(range(len(cx)))
    out: list[int | None] = []
    for x, y in zip(hx, hy, strict=True):
        best = min(free, key=lambda i: (((cx[i] - x) ** 2 + (cy[i] - y) ** 2) ** 0.5, i), default=None)
        out.append(best)
        if best is not None:
            free.remove(best)
    return out
