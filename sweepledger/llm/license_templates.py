"""License notices by template mark-up, compiled into automata over words.

A template is its wording with optional and replaceable regions:

    <<beginOptional>> … <<endOptional>>        may be left out
    <<var;match=REGEX;least=M;most=N;name=X>>  M to N words that fit REGEX (one, if not given otherwise)

A text has a notice where some run of its words takes the automaton from its start to its end: all
mandatory words stand exactly as they are written, in order, with nothing in between but what the regions admit.
Words are ``[0-9a-z]`` and all beyond ASCII, A-Z lower-cased; case, punctuation and line ends do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .license_texts import TEXTS
from .shared import WORD_BYTES, ship, slices, utf8, words_of

# The phrases and labels every document is scanned for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Parts of templates of whole texts: copyright lines, and the wording that the BSD licenses share.
HOLDERS = "<<beginOptional>>copyright <<var;match=.+;least=0;most=40>> <<endOptional>>"
BSD_TITLE = (
    "<<beginOptional>><<beginOptional>>the <<endOptional>><<beginOptional>><<var;match=[23]>> clause <<endOptional>>bsd "
    "<<beginOptional>><<var;match=[23]>> clause <<endOptional>>license <<endOptional>>"
)
BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met <<beginOptional>><<var;match=[1a]>> <<endOptional>>redistributions of source code must retain the above "
    "copyright notice this list of conditions and the following disclaimer <<beginOptional>><<var;match=[2b]>> <<endOptional>>"
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution "
)
BSD_DISCLAIMER = (
    "this software is provided by <<var;match=.+;least=1;most=20>> as is and any express or implied warranties including but not "
    "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
    "<<var;match=.+;least=1;most=20>> be liable for any direct indirect incidental special exemplary or consequential damages "
    "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage"
)

LGPL = (
    "gnu <<var;match=lesser|library>> general public license "
    "<<beginOptional>>as published by the free software foundation <<beginOptional>>either <<endOptional>><<endOptional>>"
)

# Label of the notice, and its template. ``{X}`` in a label stands for the words that regions named X took.
TEMPLATES = [
    (
        "gpl-{version}",
        "<<beginOptional>>this <<var;match=work|program|file|software|library>> is <<endOptional>>"
        "<<beginOptional>>licensed <<endOptional>><<beginOptional>>under the <<beginOptional>>terms of the <<endOptional>><<endOptional>>"
        "gnu general public license <<beginOptional>>as published by the free software foundation either <<endOptional>>"
        "version <<var;match=[0-9]+;name=version>>",
    ),
    (
        "apache-{version}",
        "<<beginOptional>>licensed <<endOptional>><<beginOptional>>under the <<endOptional>>"
        "apache license <<beginOptional>>version <<endOptional>><<var;match=[0-9]+;name=version>> <<var;match=[0-9]+;name=version>>",
    ),
    (
        "cc-by{terms}-{version}",
        "<<beginOptional>>licensed under <<endOptional>>cc by <<var;match=nc|nd|sa;least=0;most=2;name=terms>> "
        "<<var;match=[0-9]+;name=version>> <<var;match=[0-9]+;name=version>>",
    ),
    (
        "mit-notice",
        "<<beginOptional>><<var;match=released|licensed|distributed|available>> under <<endOptional>>the mit license",
    ),
    # A second number counts only where the version has one, so that a number that merely follows does not.
    *[
        ("lgpl-{version}", LGPL + f"version <<var;match={major};name=version>> <<var;match={minor};least=0;most=1;name=version>>")
        for major, minor in (("2", "[01]"), ("3", "0"))
    ],
    ("lgpl-{version}", LGPL + "version <<var;match=[014-9]|[0-9]{2,};name=version>>"),
    (
        "agpl-{version}",
        "gnu affero general public license "
        "<<beginOptional>>as published by the free software foundation <<beginOptional>>either <<endOptional>><<endOptional>>"
        "version <<var;match=[0-9]+;name=version>>",
    ),
    (
        "mpl-{version}",
        "<<beginOptional>>this source code form is subject to the terms of the <<endOptional>>"
        "mozilla public license <<var;match=v|version>> <<var;match=[0-9]+;name=version>> <<var;match=[0-9]+;name=version>>"
        "<<beginOptional>> if a copy of the mpl was not distributed with this file you can obtain one at "
        "<<var;match=https?>> <<beginOptional>>www <<endOptional>>mozilla org mpl 2 0<<endOptional>>",
    ),
    (
        "apache-{version}-header",
        "licensed under the apache license version <<var;match=[0-9]+;name=version>> <<var;match=[0-9]+;name=version>> the license "
        "you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "<<var;match=https?>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "mit-text",
        "<<beginOptional>><<beginOptional>>the <<endOptional>>mit license <<beginOptional>>mit <<endOptional>><<endOptional>>" + HOLDERS +
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
        "the software is furnished to do so subject to the following conditions the above copyright notice and this permission "
        "notice <<beginOptional>>including the next paragraph <<endOptional>>shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but "
        "not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall "
        "<<var;match=.+;least=1;most=12>> be liable for any claim damages or other liability whether in an action of contract tort "
        "or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    ("bsd-2-clause-text", BSD_TITLE + HOLDERS + BSD_CONDITIONS + BSD_DISCLAIMER),
    (
        "bsd-3-clause-text",
        BSD_TITLE + HOLDERS + BSD_CONDITIONS +
        "<<beginOptional>><<var;match=[3c]>> <<endOptional>>neither the name of <<var;match=.+;least=1;most=20>> nor the names of "
        "<<var;match=.+;least=0;most=8>> contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission " + BSD_DISCLAIMER,
    ),
    (
        "isc-text",
        "<<beginOptional>><<beginOptional>>the <<endOptional>>isc license <<beginOptional>>isc <<endOptional>><<endOptional>>" + HOLDERS +
        "permission to use copy modify and <<beginOptional>>or <<endOptional>>distribute this software for any purpose with or "
        "without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<var;match=.+;least=1;most=12>> disclaims all warranties with regard to this software "
        "including all implied warranties of merchantability and fitness in no event shall <<var;match=.+;least=1;most=12>> be liable "
        "for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
        "profits whether in an action of contract negligence or other tortious action arising out of or in connection with the "
        "use or performance of this software",
    ),
    *TEXTS,
]


@dataclass(frozen=True)
class Step:
    """One edge of an automaton: a word, or a pattern for one, or none (``skip``)."""

    to: int
    word: bytes | None = None
    pattern: re.Pattern | None = None
    name: str = ""


class Automaton:
    """A template's states, from 0 to ``end``; ``longest`` is the number of words it takes at most, ``anchors``
    its mandatory words, longest first, without all of which no text has the notice."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.steps: list[list[Step]] = [[]]
        self.longest = 0
        self.anchors: list[bytes] = []
        open_at: list[int] = []
        for part in re.split(r"(<<.*?>>)", template):
            if part == "<<beginOptional>>":
                open_at.append(len(self.steps) - 1)
            elif part == "<<endOptional>>":
                self.steps[open_at.pop()].append(Step(len(self.steps) - 1))
            elif part.startswith("<<var"):
                given = dict(p.split("=", 1) for p in part[2:-2].split(";")[1:])
                pattern = re.compile(utf8(given["match"]))
                least, most = int(given.get("least", 1)), int(given.get("most", 1))
                begin = len(self.steps) - 1
                for _ in range(most):
                    self._next(Step(len(self.steps), pattern=pattern, name=given.get("name", "")))
                for k in range(least, most):
                    self.steps[begin + k].append(Step(len(self.steps) - 1))
            else:
                for word in words_of(part):
                    self._next(Step(len(self.steps), word=word))
                    if not open_at:
                        self.anchors.append(b" " + word + b" ")
        if open_at:
            raise ValueError(f"an optional region of {label} is not closed")
        self.end = len(self.steps) - 1
        self.anchors = sorted(set(self.anchors), key=len, reverse=True)
        edges = [s for at in self._reach({0: ()}) for s in self.steps[at]]
        self.first_words = {s.word for s in edges if s.word is not None}
        self.first_patterns = [s.pattern for s in edges if s.pattern is not None]

    def may_begin(self, word: bytes) -> bool:
        return word in self.first_words or any(p.fullmatch(word) for p in self.first_patterns)

    def _next(self, step: Step) -> None:
        self.steps[-1].append(step)
        self.steps.append([])
        self.longest += 1

    def _reach(self, states: dict[int, tuple]) -> dict[int, tuple]:
        """With all states that can be entered without a word; the first way to a state stays."""
        waiting = list(states)
        while waiting:
            at = waiting.pop()
            for step in self.steps[at]:
                if step.word is None and step.pattern is None and step.to not in states:
                    states[step.to] = states[at]
                    waiting.append(step.to)
        return states

    def accept(self, words: list[bytes], begin: int) -> tuple[int, tuple] | None:
        """End and taken variables of the longest run of words from ``begin`` on that the automaton accepts."""
        states, found = self._reach({0: ()}), None
        for i in range(begin, len(words)):
            after: dict[int, tuple] = {}
            for at, taken in states.items():
                for step in self.steps[at]:
                    if step.word == words[i] if step.word is not None else step.pattern and step.pattern.fullmatch(words[i]):
                        more = taken if step.word is not None else (*taken, (step.name, words[i]))
                        after.setdefault(step.to, more)
            if not after:
                break
            states = self._reach(after)
            if self.end in states:
                found = (i + 1, states[self.end])
        return found

    def named(self, taken: tuple) -> str:
        """The label with the words its variables took."""
        text = self.label
        version = ".".join(w.decode() for n, w in taken if n == "version")
        terms = "".join("-" + w.decode() for n, w in taken if n == "terms")
        return text.replace("{version}", version).replace("{terms}", terms)


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        cut = [(words_of(p), label) for p, label in phrases.items()]
        self.phrases = [(p, label, b" " + b" ".join(p) + b" ") for p, label in cut if p]
        self.automata = [Automaton(label, template) for label, template in templates]

    def scan(self, text: str | None) -> dict:
        words = [] if text is None else utf8(text).translate(WORD_BYTES).split()
        flat = b" " + b" ".join(words) + b" "
        base: list[tuple[int, str]] = []
        for phrase, label, anchor in self.phrases:
            if anchor in flat:
                n = len(phrase)
                base += [(i, label) for i, w in enumerate(words) if w == phrase[0] and words[i : i + n] == phrase]
        notices: list[dict] = []
        for automaton in self.automata:
            if not all(anchor in flat for anchor in automaton.anchors):
                continue
            done = 0
            for begin, word in enumerate(words):
                if begin < done or not automaton.may_begin(word):
                    continue  # a notice's own words begin no other
                if run := automaton.accept(words, begin):
                    done = run[0]
                    share = (done - begin) / automaton.longest
                    notices.append({"label": automaton.named(run[1]), "begin": begin, "end": done, "share": share})
        return {"n_words": len(words), "base": base, "notices": notices}


RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("notices", pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("share", pa.float64())]))),
    ]
)


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None
) -> DataFrame:
    """One row per row of ``docs``, from its whole text:

    ``n_words``; ``n_base``, the places at which a phrase's words stand one after the other, with
    ``first_word`` and ``last_word``, the smallest and largest of their starts (null without one) and
    ``base_labels``; ``notices``, the runs of words that a template accepts, with the words they
    take and their share of the template's longest form; ``labels``, base ones and notices'; ``score``: the best share of a notice, else
    half for a phrase alone, else 0. Labels are distinct, sorted and joined by commas; without any, empty.

    A null text counts as empty. Repeated rows stay; other columns are not read; an empty table gives no rows. No
    shuffle; a row costs time in proportion to its words.
    """
    ship(docs.sparkSession)
    phrases, templates = phrases or PHRASES, templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = scanner.scan(text)
                starts = [i for i, _ in found["base"]]
                base = {label for _, label in found["base"]}
                shares = [n["share"] for n in found["notices"]]
                rows.append(
                    {
                        "doc_id": doc_id,
                        "n_words": found["n_words"],
                        "n_base": len(starts),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(sorted(base | {n["label"] for n in found["notices"]})),
                        "score": max(shares, default=0.5 if base else 0.0),
                        "notices": found["notices"],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=RESULT)

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, notices array<struct<label:string,begin:int,end:int,share:double>>",
    )
