"""Metaphone codes after Lawrence Philips' published rules (1990)."""

from __future__ import annotations

_VOWELS = set("AEIOU")
_FRONT = set("EIY")


def metaphone(text: str) -> str:
    """The codes of a text's words, with a space between words, so that two words never sound like one."""
    return " ".join(code for word in text.split() if (code := _word(word)))


def _word(word: str) -> str:
    """The code of a word; other characters than A-Z are skipped."""
    w = "".join(c for c in word.upper() if "A" <= c <= "Z")
    w = "".join(c for i, c in enumerate(w) if i == 0 or c != w[i - 1] or c == "C")
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[:1] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out = []
    at = lambda i: w[i] if 0 <= i < len(w) else ""
    skip = 0
    for i, c in enumerate(w):
        if skip:
            skip -= 1
            continue
        before, after, second = at(i - 1), at(i + 1), at(i + 2)
        if c in _VOWELS:
            out.append(c if i == 0 else "")
        elif c == "B":
            out.append("" if before == "M" and not after else "B")
        elif c == "C":
            if after == "H":
                out.append("K" if before == "S" else "X")
                skip = 1
            elif after == "I" and second == "A":
                out.append("X")
            elif after in _FRONT:
                out.append("" if before == "S" else "S")
            else:
                out.append("K")
        elif c == "D":
            out.append("J" if after == "G" and second in _FRONT else "T")
        elif c == "G":
            if after == "H" and second and second not in _VOWELS:
                out.append("")
            elif after == "N" and w[i + 2 :] in ("", "ED"):
                out.append("")
            elif before == "D" and after in _FRONT:
                out.append("")
            else:
                out.append("J" if after in _FRONT else "K")
        elif c == "H":
            out.append("" if before in set("CSPTG") or (before in _VOWELS and after not in _VOWELS) else "H")
        elif c == "K":
            out.append("" if before == "C" else "K")
        elif c == "P":
            out.append("F" if after == "H" else "P")
        elif c == "S":
            if after == "H":
                out.append("X")
                skip = 1
            else:
                out.append("X" if after == "I" and second in ("O", "A") else "S")
        elif c == "T":
            if after == "I" and second in ("O", "A"):
                out.append("X")
            elif after == "H":
                out.append("0")
                skip = 1
            else:
                out.append("" if after == "C" and second == "H" else "T")
        elif c in "WY":
            out.append(c if after in _VOWELS else "")
        else:
            out.append({"Q": "K", "V": "F", "X": "KS", "Z": "S"}.get(c, c))
    return "".join(out)
