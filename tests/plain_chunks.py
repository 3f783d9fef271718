"""Sections, sentences, footnotes and chunks the plain way, to compare tables with."""

import re

from tessera.operators.chunking import SECTION_NAMES

LETTER_NAMES = ("FINDINGS", "PROBABLE CAUSE", "RECOMMENDATIONS", "ANALYSIS", "CONCLUSIONS")


def lines_with_place(text):
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def header_of(line):
    """(number, name) of a header line, or None."""
    plain = line.strip().upper()
    if m := re.fullmatch(r"\(([A-Z])\)\s*(.+)", plain):
        return (None, f"({m[1].lower()}) {m[2]}") if m[2] in LETTER_NAMES else None
    if plain in SECTION_NAMES:
        return None, plain
    if m := re.fullmatch(r"(\d+(?:\s*\.\s*\d+)*)\s*\.?\s*(\D.*)", plain):
        if m[2] in SECTION_NAMES:
            return re.sub(r"\s", "", m[1]), m[2]
    return None


def sections(text):
    """(name, number, start, end, method); header lines must follow a line that isn't blank."""
    if not text.strip():
        return []
    found = [(at, *h) for at, line in lines_with_place(text) if (h := header_of(line))]
    names = []
    for at, number, name in found:
        if names:
            last_at, last_number, last_name = names[-1]
            line_end = text.find("\n", last_at)
            if last_number and number and number.startswith(last_number + ".") and len(text[line_end:at].strip()) < 50:
                names[-1] = (at, number, f"{last_name} > {name}")
                continue
        names.append((at, number, name))
    if names:
        ends = [n[0] for n in names[1:]] + [len(text)]
        return [(name, number, at, end, "pattern_match") for (at, number, name), end in zip(names, ends)]
    pieces, at = [], 0
    for gap in re.finditer(r"\n\s*\n", text):
        pieces.append((at, gap.end()))
        at = gap.end()
    pieces.append((at, len(text)))
    if len(text) / len(pieces) >= 100:
        long = [(f"PARAGRAPH_{i}", None, a, b, "paragraph_fallback") for i, (a, b) in enumerate(pieces, 1) if b - a >= 50]
        if len(long) > 1:
            return long
    return [("DOCUMENT", None, 0, len(text), "no_structure")]


def sentences(text):
    """Cut at white space before a capital, after a letter or two digits with a stop."""
    out, begin, i = [], 0, 0
    while i < len(text):
        if not text[i].isspace():
            i += 1
            continue
        end = i
        while end < len(text) and text[end].isspace():
            end += 1
        before = text[max(0, i - 3) : i]
        stop = before[-1:] in (".", "!", "?") and before != ""
        worth = stop and (re.fullmatch("[a-zA-Z]", before[-2:-1] or " ") or re.fullmatch(r"\d\d", before[-3:-1] or " "))
        if worth and end < len(text) and "A" <= text[end] <= "Z":
            out.append(text[begin:i])
            begin = end
        i = end
    return [s for s in (p.strip() for p in [*out, text[begin:]]) if s]


def chunks(text, count, least=400, aim=600, most=800, overlap=100):
    """(start, end, tokens, overlap tokens, text) of each chunk."""
    rows = []
    for name, _, start, end, _ in sections(text):
        for s in sentences(text[start:end]):
            rows.append((name, text.index(s, start), s, count(s)))
    out, shared, shared_tokens = [], "", 0
    while rows:
        n = 1
        while n < len(rows):
            now, then = sum(r[3] for r in rows[:n]), sum(r[3] for r in rows[: n + 1])
            if then > most or (now >= least and then > aim):
                break
            n += 1
        own, rows = rows[:n], rows[n:]
        body = f"[{own[0][0]}] " + (shared + " " if shared else "") + " ".join(r[2] for r in own)
        out.append((own[0][1], own[-1][1] + len(own[-1][2]), count(body), shared_tokens, body))
        kept = []
        for r in reversed(own):
            if sum(k[3] for k in kept) + r[3] > overlap:
                break
            kept.insert(0, r)
        shared, shared_tokens = " ".join(k[2] for k in kept), sum(k[3] for k in kept)
    return out
