"""The piece table of a SentencePiece model file, and texts as words of pieces.

The table is used as a unigram model: the best segmentation of a text is the one with the largest sum of scores, of
equal ones the one whose last differing piece starts earlier. A character that no piece covers costs `unknown` and
becomes its UTF-8 bytes. Text is normalised as the model file says: `▁` for a space, one more at the front.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

SPACE = "▁"
#: Scores below this mark runs of spaces in the file; they get the smallest other score instead, less 1.
FLOOR = -1e8


@dataclass(frozen=True)
class Pieces:
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    longest: int
    unknown: float

    def text_of(self) -> dict[int, bytes]:
        back = {i: p.encode() for p, i in self.ids.items()}
        return back | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}


def load(path: str) -> Pieces:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_unused(i)
    normal = {model.id_to_piece(i): i for i in range(n) if not special(i) and not model.is_byte(i)}
    raw = {p: model.get_score(i) for p, i in normal.items()}
    least = min(s for s in raw.values() if s > FLOOR)
    scores = {p: float(s if s > FLOOR else least - 1) for p, s in raw.items()}
    bytes_at = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    return Pieces(normal, scores, bytes_at, max(map(len, normal)), min(scores.values()) - 10)


def model_file() -> str:
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model")


def normalised(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


#: No piece reaches over the end of a word: a piece has its spaces at its front, and none holds a line feed.
_WORD = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def words(text: str) -> list[str]:
    return _WORD.findall(normalised(text))


def splits_cleanly(pieces: Pieces) -> bool:
    """Whether `words` cuts no piece of this table."""
    return all(len(_WORD.findall(p)) == 1 for p in pieces.ids)


def viterbi(word: str, pieces: Pieces) -> list[int]:
    """Ids of the best segmentation of a word, one position after the other."""
    best, back = [0.0], [(0, -1)]
    for end in range(1, len(word) + 1):
        top, step = float("-inf"), (0, -1)
        for start in range(max(0, end - pieces.longest), end):
            score = pieces.scores.get(word[start:end])
            if score is None and start == end - 1:
                score = pieces.unknown
            if score is not None and best[start] + score > top:
                top, step = best[start] + score, (start, pieces.ids.get(word[start:end], -1))
        best.append(top)
        back.append(step)
    out, at = [], len(word)
    while at:
        start, i = back[at]
        out.append([i] if i >= 0 else [pieces.byte_ids[b] for b in word[start:at].encode()])
        at = start
    return [i for part in reversed(out) for i in part]


def decoded(ids: list[int], text_of: dict[int, bytes]) -> str:
    """The text of ids; the space that normalisation puts at the front is taken off again."""
    text = b"".join(text_of.get(i, b"") for i in ids).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text
