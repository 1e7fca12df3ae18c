"""Formulas made from a grammar, with their text worked out from the tree they were made from."""

from __future__ import annotations

import random

from quireworks.functions.arrow import plain_math

SHELLS = ["mathrm", "textrm", "mathbf", "textbf", "textit", "text", "rm", "bf", "it", "operatorname", "boldsymbol"]
SIGNS = {"S": "§", "circ": "°", "AA": "Å", "yen": "¥", "dag": "†", "ddag": "‡", "P": "¶", "copyright": "©"}
SPACES = [r"\thinspace", r"\enspace", r"\quad", r"\qquad", r"\hfill", r"\medspace", r"\thickspace", r"\negthinspace", r"\,", r"\:", r"\;", r"\!", "~", r"\hspace { 3 m m }", r"\hspace{1cm}"]
OTHER = [r"\alpha", r"\omega", r"\frac"]


def made(rng, depth):
    """A formula's parts and what is left of each: strings between spaces."""
    source, text = [], []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["word", "digits", "shell", "script", "sign", "space", "mark", "range", "fence"] if depth else ["word", "digits", "sign"])
        if kind == "word":
            w = "".join(rng.choices("abcxyz", k=rng.randint(1, 3)))
            source.append(rng.choice([w, "{ " + w + " }"]))
            text.append(w)
        elif kind == "digits":
            d = rng.choices("0123456789", k=rng.randint(1, 3))
            source += d
            text += d
        elif kind in ("shell", "script"):
            inner, left = made(rng, depth - 1)
            head = "\\" + rng.choice(SHELLS) if kind == "shell" else rng.choice("^_")
            source.append(head + rng.choice(["", " "]) + "{ " + inner + " }")
            text += left
        elif kind == "sign":
            name = rng.choice(sorted(SIGNS))
            source.append("\\" + name)
            text.append(SIGNS[name])
        elif kind == "space":
            source.append(rng.choice(SPACES))
        elif kind == "mark":
            m = rng.choice([":", ".", ","])
            source.append("{ " + m + " }")
            text.append(m)
        elif kind == "range":
            a, b = str(rng.randint(1, 99)), str(rng.randint(1, 99))
            source += [a, "-", b]
            text += [a, "-", b]
        else:
            inner, left = made(rng, depth - 1)
            source.append(r"\left( " + inner + r" \right)")
            text += ["(", *left, ")"]
    return " ".join(source), text


def settled(parts):
    """Digits that stand apart are one number, and a hyphen between numbers is a dash."""
    joined = []
    for p in parts:
        if p.isdigit() and joined and joined[-1].isdigit():
            joined[-1] += p
        else:
            joined.append(p)
    out = []
    for k, p in enumerate(joined):
        if p == "-" and 0 < k < len(joined) - 1 and joined[k - 1][-1].isdigit() and joined[k + 1][0].isdigit():
            out.append("–")
        else:
            out.append(p)
    line = ""
    for k, p in enumerate(out):
        line += p if not line or p == "–" or out[k - 1] == "–" else " " + p
    return line


def test_made_formulas():
    rng, seen, kept, dropped = random.Random(17), 0, 0, 0
    while seen < 10_000:
        source, text = made(rng, 3)
        other = rng.random() < 0.2
        if other:
            source += " " + rng.choice(OTHER)
        if len(source) > 118:
            continue
        seen += 1
        typed = any(f"\\{x}" in source for x in ("mathrm", "times", "mathbf", "text", "rm", "bf", "it"))
        want = settled(text) if not other else "" if typed else f"$ {source} $"
        kept, dropped = kept + want.startswith("$"), dropped + (want == "")
        assert plain_math(f"so $ {source} $ it") == f"so {want} it", source
    assert kept > 300 and dropped > 300


def test_lines_without_formulas():
    assert plain_math(None) is None and plain_math("") == "" and plain_math("a $ b") == "a $ b" and plain_math("$" + "x" * 121 + "$") == "$" + "x" * 121 + "$"
