"""Plain Python statements of the order-dependent rules, for small random inputs."""


def iou(a, b):
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    area = [(q[2] - q[0]) * (q[3] - q[1]) for q in (a, b)]
    return inter / (sum(area) - inter) if inter else 0.0


def smaller_share(a, b):
    inter = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return inter / min((q[2] - q[0]) * (q[3] - q[1]) for q in (a, b)) if inter else 0.0


def walk(boxes, clash, kept=()):
    kept = list(kept)
    for b in boxes:
        if not any(clash(k, b) for k in kept):
            kept.append(b)
    return kept


def read(boxes, rtl=False, share=0.4):
    """Boxes (x1, y1, x2, y2, …) in reading order."""
    lines = []
    for b in sorted(boxes, key=lambda q: ((q[1] + q[3]) / 2, q[:4])):
        for line in lines:
            head = line[0]
            if min(b[3], head[3]) - max(b[1], head[1]) > share * min(b[3] - b[1], head[3] - head[1]):
                line.append(b)
                break
        else:
            lines.append([b])
    return [b for line in lines for b in sorted(line, key=lambda q: q[0], reverse=rtl)]


def unique(stems):
    used, out = set(), []
    for stem in stems:
        name, n = stem or "panel", 2
        while name in used:
            name, n = f"{stem or 'panel'}_{n}", n + 1
        used.add(name)
        out.append(name)
    return out
