"""Plain Python counterparts that tests compare with."""

import re

TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]", re.ASCII)


def tokens(text):
    return [m.group() for m in TOKEN.finditer(text)]


def starts(text):
    return [m.start() for m in TOKEN.finditer(text)]


def token_index(text, off):
    at = starts(text)
    if not at:
        return -1
    begun = sum(s <= off for s in at)
    return min(begun, len(at) - 1) - 1


def sentence_of(text, off):
    """(sentence, position, length) of the token at an offset."""
    index = token_index(text, off)
    toks = tokens(text)
    owner, sent = [], 0
    for t in toks:
        owner.append(sent)
        sent += t in ".!?"
    if not toks:
        return 0, index + 1, 0
    own = owner[max(index, 0)]
    first = owner.index(own)
    position = index + 1 if own == 0 else index - first
    return own, position, owner.count(own)


def stop_point(losses, patience, margin):
    """(stop step, best step, best loss) by walking over the losses once."""
    best, best_step, misses = float("inf"), None, 0
    for step, loss in enumerate(losses, 1):
        if best > loss + margin:
            best, best_step, misses = loss, step, 0
        else:
            misses += 1
        if misses > patience:
            return step, best_step, best
    return None, best_step, best
