"""The folds of the chunk build: plain Python over a document's numbers. No pandas is loaded here, so that a worker that runs only these stays small."""

from __future__ import annotations

NOISE, OPTION, TEXT = range(3)


def option_owners(codes: list[int], limit: int) -> list[int]:
    """For each paragraph (4 * length + kind) the position of the one that it is appended to, or its own."""
    totals, owners, question, last = {}, [], None, None
    for i, code in enumerate(codes):
        chars, kind = divmod(code, 4)
        home = last if question is None else question
        if kind == OPTION and home is not None and totals[home] > 0 and totals[home] + chars < limit:
            totals[home] += chars
            owners.append(home)
            continue
        totals[i], last = chars, i
        owners.append(i)
        question = i if kind == TEXT else question
    return owners


def members(groups: list[int]) -> list[list[int]]:
    """The places of each group's members, groups in the order in which they begin."""
    out: dict[int, list[int]] = {}
    for i, g in enumerate(groups):
        out.setdefault(g, []).append(i)
    return list(out.values())


def tiny_groups(lengths: list[int], least: int, limit: int) -> list[int]:
    """Group numbers: a short paragraph joins its predecessor's group, the first ones the paragraph after them.

    A group that short paragraphs began at the start of the document stays open for the first long one.
    """
    out, group, held, is_open = [], -1, 0, False
    for n in lengths:
        short = n < least
        if group >= 0 and (short or is_open) and held + n < limit:
            held += n
        else:
            is_open = short and (group < 0 or is_open)
            group, held = group + 1, n
        is_open = is_open and short
        out.append(group)
    return out


def piece_starts(lengths: list[int], limit: int) -> list[int]:
    """Where pieces of consecutive sentences start, each under `limit` unless one sentence is longer."""
    starts, held = [], 0
    for i, n in enumerate(lengths):
        if i == 0 or (held > 0 and held + n >= limit):
            starts.append(i)
            held = 0
        held += n
    return starts


def pack_groups(lengths: list[int], limit: int) -> list[int]:
    """Chunk numbers: the next paragraph joins while the chunk stays within `limit`."""
    out, group, held = [], -1, 0
    for n in lengths:
        if group >= 0 and held + n <= limit:
            held += n
        else:
            group, held = group + 1, n
        out.append(group)
    return out


def merged_groups(codes: list[int], least: int, limit: int) -> list[list[int]]:
    """The places of the paragraphs (2 * length + 1 where the next can be taken) that merge_incomplete and merge_tiny bring together."""
    pairs, i = [], 0
    while i < len(codes):
        pairs.append(range(i, i + 1 + codes[i] % 2))
        i = pairs[-1].stop
    lengths = [sum(codes[i] // 2 for i in pair) for pair in pairs]
    return [[i for k in places for i in pairs[k]] for places in members(tiny_groups(lengths, least, limit))]


def packed_pieces(sizes: list[list[int]], limit: int) -> list[list[list[int]]]:
    """For each chunk its pieces as [text, first sentence, number of sentences]: texts, told by their sentences' lengths, cut by piece_starts and packed by pack_groups."""
    pieces = []
    for i, parts in enumerate(sizes):
        starts = piece_starts(parts, limit)
        pieces += [[i, a, b - a] for a, b in zip(starts, [*starts[1:], len(parts)], strict=False)]
    lengths = [sum(sizes[i][a : a + n]) for i, a, n in pieces]
    return [[pieces[k] for k in places] for places in members(pack_groups(lengths, limit))]
