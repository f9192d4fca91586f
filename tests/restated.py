"""Plain-Python statements of the rules, for small random inputs."""

from __future__ import annotations

import re

CLOCK = re.compile(r"\b[0-9]{2}:[0-9]{2}(?::[0-9]{2})?\b")
LOOSE_CLOCK = re.compile(r"[0-9]{2}:[0-9]{2}(?::[0-9]{2})?\b")


def plan(hints, fps, total, count, radius, most):
    rate = fps if fps else 25.0
    end = max(0.0, total / rate - 1e-6) if total > 0 else 0.0
    if hints:
        raw = {round(min(max(h + d, 0.0), end), 2) for h in hints for d in (-radius, 0.0, radius)}
    else:
        n = max(count, 1)
        raw = {round((i + 0.5) / n * end, 2) for i in range(n)}
    times = sorted(raw)
    step = max(1, -(-len(times) // most))
    return [(t, round(t * rate)) for t in times[::step]]


def scan(readable, fps, total, count, most):
    """Frames of a scan over a set of readable indices, stopping at the first gap."""
    rate, want = max(1.0, fps if fps else 25.0), max(1, min(most, count))
    stride, found, i = max(1, total // (want + 1)), [], 0
    while i in readable and len(found) < want:
        if i % stride == 0:
            found.append((i / rate, i))
        i += 1
    return found


def normal(text, kind, strict):
    text = (text or "").strip()
    miss = "" if strict else text
    words = {"Yes/No": ("Yes", "No"), "True/False": ("True", "False")}.get(kind)
    if words:
        low = text.lower()
        inside = [w for w in words if w.lower() in low]
        if len(inside) == 1:
            return inside[0]
        return next((w for w in words if low[:1] == w[0].lower()), miss)
    if kind == "Timestamp":
        match = CLOCK.search(text) or (strict and LOOSE_CLOCK.search(text)) or None
        if match is None:
            return miss
        return (match.group() + ":00")[:8]
    return text


def split(text):
    at = re.search(r"because .", text, re.I | re.S)
    cut = at.start() if at else len(text)
    return text[:cut].strip(), text[cut:].strip()


def cut(text):
    marker = re.search(r"(\A|\n)assistant", text, re.I)
    return text[marker.end():].strip() if marker else text.strip()


def lenient(text, kind):
    main, because = split(cut(text))
    answer, other = normal(main, kind, False), normal(because, kind, False)
    roles = {"", "system", "user", "assistant"}
    if kind in ("Yes/No", "True/False"):
        return other if answer.lower() in roles and other.lower() not in roles else answer
    if kind == "Timestamp":
        return next((a for a in (answer, other) if CLOCK.search(a)), "00:00:00")
    return answer
