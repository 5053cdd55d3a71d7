"""Plain Python models of the text rules, for comparison with the Spark expressions."""

import re

SEPARATORS = re.compile(r"[ \t\n\x0b\f\r,，。；;：:、/\\()（）\[\]{}<>]+")
CONTROLS = "".join(chr(n) for n in range(33))
SYMBOL_ENDS = ("Controller", "Service", "Mapper", "Request", "Response")


def chunks(text, size=500, overlap=80):
    size = max(100, size)
    overlap = max(0, min(overlap, size // 2))
    body = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip(CONTROLS)
    starts = range(0, max(1, len(body)), size - overlap)
    pieces = []
    for start in starts:
        pieces.append(body[start:start + size].strip(CONTROLS))
        if start + size >= len(body):
            break
    return [piece for piece in pieces if piece]


def terms(query):
    whole = (query or "").strip(CONTROLS)
    if not whole:
        return []
    parts = [part.strip(CONTROLS) for part in SEPARATORS.split(whole)]
    return [part for part in parts if 0 < len(part) <= 50] or [whole]


def keyword_score(query, content):
    words = terms(query)
    if not words or not (content or "").strip():
        return 0.0
    counts = [content.lower().count(word.lower()) if word.strip() else 0 for word in words]
    return min(1.0, sum(n > 0 for n in counts) / len(words) + min(0.3, sum(counts) * 0.03))


def exact_score(query, content):
    words = terms(query)
    return sum(word.lower() in content.lower() for word in words) / len(words) if words else 0.0


def symbol_like(term):
    return (any(mark in term for mark in "./-_") or bool(re.fullmatch(".*[A-Z].*[a-z].*", term))
            or term.endswith(SYMBOL_ENDS))


def symbol_score(query, content):
    symbols = [term for term in terms(query) if symbol_like(term)]
    return sum(term in content for term in symbols) / len(symbols) if symbols else 0.0


def cut(text, size):
    text = text or ""
    return text if len(text) <= size else text[:size] + "..."


def preview(text):
    return cut((text or "").replace("\r", " ").replace("\n", " ").strip(CONTROLS), 300)
