"""Words of texts by whole Arrow batches: the words of text.py, several times cheaper where a text meets a few given words or phrases.

Columns are lower-cased by Spark and come as bytes, so that words are the same
as those of text.py for every text: all bytes but those of words become spaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidmill.functions.text import PLURALS, _lower

_LETTERS = b"abcdefghijklmnopqrstuvwxyz0123456789"
#: Bytes of words kept, all others a space: those of text.all_words() and of text.token_set().
WORDS, TOKENS = (bytes(c if c in kept else 32 for c in range(256)) for kept in (_LETTERS, _LETTERS + b"_"))
#: Of words, with the ends of sentences as points.
SENTENCES = bytes(46 if c in b".!?;" else WORDS[c] for c in range(256))
_PLURALS = {k.encode(): v.encode() for k, v in PLURALS.items()}


def lowered(c: Column) -> Column:
    return _lower(c).cast("binary")


def folded(words: list[bytes]) -> list[bytes]:
    """text.singular() of each word."""
    return [w[:-1] if w[-1] == 115 and len(w) > 3 and w[-2] != 115 else w for w in words]


def mapped(words: list[bytes]) -> list[bytes]:
    """Words with the plurals of PLURALS replaced."""
    return words if _PLURALS.keys().isdisjoint(words) else [_PLURALS.get(w, w) for w in words]


def padded(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def held(text: Column, words: Iterable[str], kept: bytes = TOKENS) -> Column:
    """The distinct ones of ``words`` (a bounded list) that a text holds."""
    known = frozenset(w.encode() for w in words if w is not None)

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[w.decode() for w in known.intersection(x.translate(kept).split())] for x in batch.to_pylist()], pa.list_(pa.string()))

    return run(lowered(text))


def normalized(text: Column) -> Column:
    """text.normalized()."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([b" ".join(x.translate(WORDS).split()) for x in batch.to_pylist()], pa.binary()).cast(pa.string())

    return run(lowered(text))


def _in_all(segment: bytes, groups: list[list[list[bytes]]]) -> bool:
    """Whether every group has an alternative all of whose padded texts are in the padded segment."""
    for group in groups:
        for alternative in group:
            for t in alternative:
                if t not in segment:
                    break
            else:
                break
        else:
            return False
    return True


def _opening(groups: list[list[list[bytes]]]) -> list[list[frozenset]]:
    """For each alternative the first words of its texts: without all of them it is nowhere."""
    return [[frozenset(t.split()[0] for t in alternative) for alternative in group] for group in groups]


class _Text:
    """The words of a paper, and which of ``cues`` it holds; sentences are split when first asked for."""

    def __init__(self, title: bytes, abstract: bytes, words_of: Callable, cues: frozenset) -> None:
        self.raw, self.words_of = title + b". " + abstract, words_of
        self.first, self.second = (words_of(x.translate(WORDS).split()) for x in (title, abstract))
        self.words = self.first + self.second
        self.held = cues.intersection(self.words)
        self.sentences: list[bytes] | None = None

    def opens(self, opening: list[list[frozenset]]) -> bool:
        return all([any([alternative <= self.held for alternative in group]) for group in opening])

    def _split(self) -> None:
        # words and points between single spaces: what lies between two points is padded
        self.sentences = padded(self.words_of(self.raw.translate(SENTENCES).replace(b".", b" . ").split())).split(b".")
        self.places = [i for i, w in enumerate(self.words) if w in self.held]

    def near(self, groups: list[list[list[bytes]]], opening: list[list[frozenset]], sentences: bool, window: int | None) -> bool:
        """Whether all groups are in one sentence, or in a window that starts at the first word or at one that opens an alternative."""
        if self.sentences is None:
            self._split()
        if sentences and groups:
            if all(frozenset() in group for group in opening):  # no words are needed, but a sentence that isn't blank
                if self.raw.strip(b" .!?;"):
                    return True
            elif any([_in_all(s, groups) for s in self.sentences]):
                return True
        if window is None:
            return False
        cues = {w for group in opening for alternative in group for w in alternative}
        return any(_in_all(padded(self.words[i : i + window]), groups) for i in {0, *(i for i in self.places if self.words[i] in cues)})


def evidence(topics: list[dict], bounded: bool, window: int) -> Callable[[Column, Column], Column]:
    """Column of (title, abstract): for each topic a struct of topic_id, topic_field, evidence and generic_only; see retrieval.evidence().

    Topics have topic_id, topic_field, phrases, groups, generic and
    sentence_only, their texts normalised already.
    """
    coded = lambda x: x.encode() if isinstance(x, str) else None if x is None else [coded(y) for y in x]
    profiles = []
    for t in topics:
        phrases, groups, generic = (coded(t[c]) for c in ("phrases", "groups", "generic"))
        wide = t["sentence_only"] is False and groups is not None and (bounded or len(groups) > 1)
        # whole words only where phrases are bounded
        phrases = [(p, frozenset(p.split() if bounded else ())) for p in phrases or []]
        profiles.append((phrases, groups, _opening(groups or []), generic, wide))
    cues = frozenset(w for *_, opening, _, _ in profiles for group in opening for alternative in group for w in alternative) | {w for phrases, *_ in profiles for _, own in phrases for w in own}
    words_of = mapped if bounded else folded
    ids, fields = ([t[c] for t in topics] for c in ("topic_id", "topic_field"))
    kind = pa.struct([("topic_id", pa.string()), ("topic_field", pa.string()), ("evidence", pa.float64()), ("generic_only", pa.bool_())])

    def of_paper(title: bytes, abstract: bytes, whole: bool) -> Iterator[tuple[float, bool | None]]:
        text = _Text(title, abstract, words_of, cues)
        every = padded(text.words)
        t, a = (padded(text.first), padded(text.second)) if bounded else (b" ".join(text.first), b" ".join(text.second))
        seen = every if bounded else t + b" " + a
        for phrases, groups, opening, generic, wide in profiles:
            value = 0.0
            # what is in the title or the abstract is in all words
            found = [p for p, own in phrases if own <= text.held and p in every]
            if found and any(p in t for p in found):
                value = 1.0
            elif found and any(p in a for p in found):
                value = 0.9
            elif groups is not None and text.opens(opening) and _in_all(every, groups):
                # a text without a title or an abstract has no sentences
                if text.near(groups, opening, whole, window if wide and text.words else None):
                    value = 0.8
            yield value, value == 0 and (None if generic is None else any(g in seen for g in generic))

    @F.arrow_udf("array<struct<topic_id:string,topic_field:string,evidence:double,generic_only:boolean>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for title, abstract, whole in batches:
            n = len(title)
            got = [x for row in zip(title.to_pylist(), abstract.to_pylist(), whole.to_pylist()) for x in of_paper(*row)]
            columns = [pa.array(ids * n, pa.string()), pa.array(fields * n, pa.string()), pa.array([e for e, _ in got], pa.float64()), pa.array([g for _, g in got], pa.bool_())]
            ends = pa.array(range(0, n * len(ids) + 1, len(ids)) if ids else [0] * (n + 1), pa.int32())
            yield pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(kind)))

    return lambda title, abstract: run(lowered(title), lowered(abstract), title.isNotNull() & abstract.isNotNull())
