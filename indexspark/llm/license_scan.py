"""License scan: templates with optional and replaceable regions, compiled into token automata.

A template is wording with markup: ``<<opt>> ... <</opt>>`` may be absent, ``<<var:n>>`` stands for up to n words of any
kind. It becomes an automaton over words; a text holds the template where the automaton accepts, that is, where all its
mandatory words stand exactly, in order, with nothing between but what the markup allows. Case, punctuation and layout
do not count, as words are runs of letters, digits and non-ASCII characters with A-Z in lower case.

Besides, three fixed phrases give base labels at every place where their words stand consecutively. The score is the
share of a text's words inside accepted regions and phrases.

Only texts with an anchor (a word that every template and phrase must contain) are handed to the automata; this is a
necessary condition, so nothing is lost. Texts are read whole. Defined cases: a null or empty text has no words and no
labels; rows repeated are scanned each; an empty table gives an empty result; only doc_id and text are read, whatever
other columns there are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording that several templates share.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<opt>>1.<</opt>> Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. <<opt>>2.<</opt>> Redistributions in binary form must reproduce
the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. """
_BSD_NAMES = """ Neither the name of <<var:20>> nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY <<var:20>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
<<var:20>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL = """This <<var:4>> is free software: you can redistribute it and/or modify it under the terms of the GNU
<<opt>>Lesser<</opt>> General Public License as published by the Free Software Foundation, either version <<var:3>> of
the License, or (at your option) any later version. This <<var:4>> is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the GNU <<opt>>Lesser<</opt>> General Public License for more details. You should have received a copy of the GNU
<<opt>>Lesser<</opt>> General Public License along with this <<var:4>> If not,"""

#: Public license wordings with markup, to the end of their mandatory wording, by label.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice <<opt>>(including the next paragraph)<</opt>> shall be included in all
copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL <<var:20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND <<var:20>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:20>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause-text": _BSD + _BSD_END,
    "bsd-3-clause-text": _BSD + "<<opt>>3.<</opt>>" + _BSD_NAMES + _BSD_END,
    "bsd-4-clause-text": _BSD + """<<opt>>3.<</opt>> All advertising materials mentioning features or use of this software
must display the following acknowledgement: This product includes software developed by <<var:20>>
<<opt>>4.<</opt>>""" + _BSD_NAMES + _BSD_END,
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at <<var:12>> Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "gpl-header": _GPL + " see <<opt>>http<</opt>> <<opt>>https<</opt>> www.gnu.org/licenses",
    "gpl-header-address": _GPL + """ write to the Free Software Foundation
<<opt>>Inc. <<opt>>51 Franklin Street<<opt>>, Fifth Floor<</opt>>, Boston, MA 02110-1301<<opt>> USA<</opt>><</opt>>
<<opt>>59 Temple Place<<opt>>, Suite 330<</opt>>, Boston, MA 02111-1307<<opt>> USA<</opt>><</opt>>
<<opt>>675 Mass Ave, Cambridge, MA 02139<<opt>> USA<</opt>><</opt>><</opt>>""",
    "mit-notice": "<<opt>>this <<var:3>> is<</opt>> released under the <<opt>>terms of the<</opt>> mit license",
    "apache-2.0-notice": "licensed under the <<opt>>terms of the<</opt>> apache license <<opt>>version<</opt>> 2.0",
    "gpl-notice": """licensed under the <<opt>>terms of the<</opt>> gnu general public license <<opt>><<opt>>version<</opt>>
<<var:2>><</opt>>""",
}
#: Each phrase and each template's mandatory wording contains one of these.
ANCHORS = ("license", "permission", "redistribution")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_MARK = re.compile(r"<<opt>>|<</opt>>|<<var:(\d+)>>")
RESULT = "struct<n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double>"


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER))


@dataclass
class Automaton:
    """States with one word or any word on their way out, and ways that cost no word."""

    step: list[tuple[str | None, int] | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.step.append(None)
        self.free.append([])
        return len(self.step) - 1

    def follow(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen


def compiled(template: str) -> tuple[Automaton, set[str]]:
    """The automaton of a template (state 0 to the last state) and its possible first words."""
    a, at, opened, done = Automaton(), 0, [], 0
    at = a.state()
    for mark in [*_MARK.finditer(template), None]:
        for w in words(template[done : mark.start() if mark else None]):
            nxt = a.state()
            a.step[at] = (w, nxt)
            at = nxt
        if mark is None:
            break
        done = mark.end()
        if mark[0] == "<<opt>>":
            inner = a.state()
            a.free[at].append(inner)
            opened.append(at)
            at = inner
        else:
            begin = opened.pop() if mark[0] == "<</opt>>" else None
            stops = [at] if begin is not None else []
            for _ in range(int(mark[1] or 0)):
                nxt = a.state()
                a.step[at] = (None, nxt)
                stops.append(at)
                at = nxt
            out = a.state()
            a.free[at].append(out)
            for s in [begin] if begin is not None else stops:
                a.free[s].append(out)
            at = out
    first = {a.step[s][0] for s in a.follow({0}) if a.step[s]}
    if None in first:
        raise ValueError("a template must begin with wording")
    return a, first


def accepted(a: Automaton, tokens: list[str], begin: int) -> int | None:
    """The end of the longest run of words from ``begin`` that the automaton accepts."""
    last, states, end, i = len(a.step) - 1, a.follow({0}), None, begin
    while states:
        if last in states:
            end = i
        if i == len(tokens):
            break
        states = a.follow({t for s in states if (way := a.step[s]) for w, t in [way] if w is None or w == tokens[i]})
        i += 1
    return end


def matches(tokens: list[str], machines: dict[str, tuple[Automaton, set[str]]]) -> list[tuple[int, int, str]]:
    """(start, end, label) of the regions that templates accept; of one template they do not overlap."""
    places: dict[str, list[int]] = {}
    for i, t in enumerate(tokens):
        places.setdefault(t, []).append(i)
    out = []
    for label, (a, first) in machines.items():
        free = 0
        for i in sorted(p for w in first for p in places.get(w, ())):
            if i >= free and (end := accepted(a, tokens, i)) is not None:
                out.append((i, end, label))
                free = end
    return out


def judged(text: str, machines: dict, phrases: dict[str, str]) -> dict:
    """All results of one text."""
    tokens = words(text)
    base = []
    for phrase, label in phrases.items():
        p = phrase.split()
        base += [(i, i + len(p), label) for i in range(len(tokens) - len(p) + 1) if tokens[i] == p[0] and tokens[i : i + len(p)] == p]
    found = matches(tokens, machines)
    covered = {i for s, e, _ in [*base, *found] for i in range(s, e)}
    return {
        "n_base": len(base),
        "first_word": min((s for s, _, _ in base), default=None),
        "last_word": max((s for s, _, _ in base), default=None),
        "base_labels": ",".join(sorted({x for _, _, x in base})),
        "labels": ",".join(sorted({x for _, _, x in [*base, *found]})),
        "score": len(covered) / len(tokens) if tokens else 0.0,
    }


def _anchored(text: Column) -> Column:
    return text.rlike("(?i:" + "|".join(ANCHORS) + ")")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    anchors = ANCHORS

    def mandatory(template: str) -> list[str]:
        while re.search(plain := r"<<opt>>(?:(?!<<opt>>).)*?<</opt>>", template, re.S):
            template = re.sub(plain, " ", template, flags=re.S)
        return words(_MARK.sub(" ", template))

    for wording in [*templates.values(), *phrases]:
        if not set(mandatory(wording)) & set(anchors):
            raise ValueError(f"no anchor among the mandatory words of: {wording[:60]}")
    made: dict = {}

    @F.arrow_udf(RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        if not made:  # automata are built once in each worker
            made.update({k: compiled(t) for k, t in templates.items()})
        return pa.array([judged(t, made, phrases) if t else judged("", {}, {}) for t in texts.to_pylist()], texts_type())

    text = C.text_or_empty()
    n = F.regexp_count(text, F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long").alias("n_words")
    rows = docs.select("doc_id", n, judge(F.when(_anchored(text), text)).alias("r"))
    return rows.select("doc_id", "n_words", "r.*")


def texts_type() -> pa.DataType:
    names = [("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    return pa.struct(names)


def report(docs: DataFrame) -> DataFrame:
    return scan(docs)
