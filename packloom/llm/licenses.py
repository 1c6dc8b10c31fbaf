"""License scans with ordered signature rules.

Each rule is a regex with a label, a priority, a score and keywords, one of which every match holds: license names in the
forms in which they are cited (``FAMILIES`` by ``FORMS``), and sentences of the license texts (``license_texts``). One automaton pass
over the text finds which keywords occur, and only their rules run. A detection inside the interval of one of better or equal priority is
suppressed, so "licensed under the MIT License" counts once.

Texts have A-Z lower-cased; words are runs of digits, a-z and characters from U+0080 on. Defined results: a null text
is an empty text (0 words, no places, empty labels, score 0); repeated rows each get their own result; an empty table
gives an empty result; extra columns of any name are ignored; null ids are kept; very long texts are read whole; of rules
that tie for an interval the first listed stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.llm.batches import bound_batches, pieces
from packloom.llm.license_texts import TEXTS

#: Fixed values of the contract: label -> phrase.
BASE_PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Label, SPDX identifiers, keyword (one word) that every name holds, and the regex of the name.
FAMILIES = [
    ("mit", "mit", "mit", r"mit(?:/x11)?(?: licen[cs]e)?"),
    ("mit-0", "mit-0", "mit", r"mit no attribution(?: licen[cs]e)?"),
    ("x11", "x11", "x11", r"x11 licen[cs]e"),
    ("isc", "isc", "isc", r"isc licen[cs]e"),
    ("apache-1.1", r"apache-1\.1", "apache", r"apache(?: software)? licen[cs]e,? (?:version |v)?1\.1"),
    ("apache-2.0", r"apache-2\.0", "apache", r"apache(?: software)? licen[cs]e,? (?:version |v)?2(?:\.0)?"),
    ("apache", "apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", "public", r"(?:gnu )?general public licen[cs]e,? (?:as published by the free software foundation;? )?(?:either )?(?:version |v)1"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", "public", r"(?:gnu )?general public licen[cs]e,? (?:as published by the free software foundation;? )?(?:either )?(?:version |v)2"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", "public", r"(?:gnu )?general public licen[cs]e,? (?:as published by the free software foundation;? )?(?:either )?(?:version |v)3"),
    ("gpl", "gpl", "public", r"(?:gnu )?general public licen[cs]e"),
    ("gpl-short", "gpl", "gpl", r"(?:gnu )?gpl(?:[\s-]?v?[123](?:\.0)?)?"),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", "library", r"(?:gnu )?library general public licen[cs]e"),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", "lesser", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v)2\.1"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", "lesser", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v)3"),
    ("lgpl", "lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", "affero", r"(?:gnu )?affero general public licen[cs]e(?:,? (?:version |v)3)?"),
    ("bsd-2-clause", "bsd-2-clause", "bsd", r"(?:simplified|2-clause|two-clause) bsd licen[cs]e|bsd 2-clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd-3-clause", "bsd", r"(?:modified|new|revised|3-clause|three-clause) bsd licen[cs]e|bsd 3-clause(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd-4-clause", "bsd", r"(?:original|4-clause|four-clause) bsd licen[cs]e|bsd 4-clause(?: licen[cs]e)?"),
    ("bsd", "bsd", "bsd", r"bsd licen[cs]e"),
    ("mpl-1.1", r"mpl-1\.1", "mozilla", r"mozilla public licen[cs]e,? (?:version |v)?1\.1"),
    ("mpl-2.0", r"mpl-2\.0", "mozilla", r"mozilla public licen[cs]e(?:,? (?:version |v)?2\.0)?"),
    ("epl-1.0", r"epl-1\.0", "eclipse", r"eclipse public licen[cs]e,? (?:version |v)?1\.0"),
    ("epl-2.0", r"epl-2\.0", "eclipse", r"eclipse public licen[cs]e(?:,? (?:version |v)?2\.0)?"),
    ("cddl-1.0", r"cddl-1\.[01]", "development", r"common development and distribution licen[cs]e"),
    ("cpl-1.0", r"cpl-1\.0", "common", r"common public licen[cs]e"),
    ("eupl-1.2", r"eupl-1\.[12]", "european", r"european union public licen[cs]e"),
    ("artistic-2.0", r"artistic-[12]\.0", "artistic", r"artistic licen[cs]e(?:,? (?:version )?2(?:\.0)?)?"),
    ("zlib", "zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e"),
    ("bsl-1.0", r"bsl-1\.0", "boost", r"boost software licen[cs]e"),
    ("unlicense", "unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", r"wtfpl"),
    ("cc0-1.0", r"cc0-1\.0", "cc0", r"cc0(?: 1\.0)?(?: universal)?"),
    ("cc-by-sa", r"cc-by-sa-\d\.\d", "sharealike", r"creative commons attribution[\s-]sharealike(?: \d\.\d)?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc", r"cc-by-nc-\d\.\d", "noncommercial", r"creative commons attribution[\s-]noncommercial(?: \d\.\d)?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nd", r"cc-by-nd-\d\.\d", "noderivatives", r"creative commons attribution[\s-]noderivatives(?: \d\.\d)?(?: international)?(?: licen[cs]e)?"),
    ("cc-by", r"cc-by-\d\.\d", "creative", r"creative commons attribution(?: \d\.\d)?(?: international)?(?: licen[cs]e)?"),
    ("ofl-1.1", r"ofl-1\.1", "font", r"(?:sil )?open font licen[cs]e"),
    ("psf-2.0", r"psf-2\.0|python-2\.0", "python", r"python software foundation licen[cs]e"),
    ("openssl", "openssl", "openssl", r"openssl licen[cs]e"),
    ("ms-pl", "ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("ncsa", "ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)? licen[cs]e"),
    ("osl-3.0", r"osl-3\.0", "software", r"open software licen[cs]e"),
    ("afl-3.0", r"afl-3\.0", "academic", r"academic free licen[cs]e"),
    ("odbl", r"odbl-1\.0", "database", r"open database licen[cs]e"),
    ("postgresql", "postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("ruby", "ruby", "ruby", r"ruby licen[cs]e"),
    ("vim", "vim", "vim", r"vim licen[cs]e"),
]

#: Priority (1 is best), score, keyword ("" takes the family's and, around {spdx}, the stems of its identifiers), regex around {name} or {spdx}.
FORMS = [
    (1, 1.0, "spdx-license", r"spdx-license-identifier:\s*\(?(?:{spdx})(?![a-z0-9.-])"),
    (2, 0.9, "", r"(?:licen[cs]ed|released|distributed|available|provided|dual-licen[cs]ed)\s+under\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?(?:{name})(?![a-z0-9])"),
    (3, 0.8, "", r"(?:governed\s+by|subject\s+to|terms\s+of|accordance\s+with|copy\s+of)\s+(?:the\s+)?(?:{name})(?![a-z0-9])"),
    (3, 0.8, "", r"(?:^|\n)[ \t]*(?:the\s+)?(?:{name})[ \t]*(?=\n|$)"),
    (4, 0.6, "", r"licen[cs]e\s*[:=]\s*(?:the\s+)?(?:{name}|{spdx})(?![a-z0-9])"),
    (5, 0.4, "", r"(?<![a-z0-9])(?:{name})(?![a-z0-9])"),
]
_NEEDS_LICENSE = {"mit", "gpl-short", "cc0-1.0", "wtfpl"}  # a bare short name is no license by itself


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int
    score: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


def stems(spdx: str) -> list[str]:
    """The literal beginning of each SPDX identifier."""
    return [re.match(r"[a-z0-9-]+", x)[0] for x in re.sub(r"\(.*?\)", "", spdx).split("|")]


#: What may stand between two words of a license text.
GAP = r"""[\s,*#/"'“”;]+"""


def signatures() -> list[Signature]:
    """Every family in every form, then the texts; best priority first, then in the order given."""
    out = []
    for label, spdx, keyword, name in FAMILIES:
        spaced = name.replace(" ", r"[\s,]+")
        for priority, score, word, form in FORMS:
            if priority == 5 and label in _NEEDS_LICENSE:
                spaced_name = spaced.replace("(?:[\\s,]+licen[cs]e)?", r"[\s,]+licen[cs]e")
                if spaced_name == spaced:
                    continue
            else:
                spaced_name = spaced
            shown = "gpl" if label == "gpl-short" else label
            words = (word,) if word else (keyword, *stems(spdx)) if "{spdx}" in form else (keyword,)
            out.append(Signature(shown, priority, score, words, re.compile(form.format(name=spaced_name, spdx=spdx))))
    out += [Signature(label, priority, score, (word,), re.compile(f"(?<![a-z0-9]){text.replace(' ', GAP)}")) for label, priority, score, word, text in TEXTS]
    return sorted(out, key=lambda s: s.priority)


def automaton(rules: list[Signature]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k in {k for r in rules for k in r.keywords}:
        found.add_word(k, k)
    found.make_automaton()
    return found


def detect(low: str, rules: list[Signature], keywords: ahocorasick.Automaton) -> list[tuple[int, int, Signature]]:
    """The detections that stay, by start: (start, end, rule)."""
    present = {k for _, k in keywords.iter(low)}
    hits = [(m.start(), m.end(), r) for r in rules if not present.isdisjoint(r.keywords) for m in r.pattern.finditer(low)] if present else []
    hits.sort(key=lambda h: (h[0], -h[1], h[2].priority))
    kept: list[tuple[int, int, Signature]] = []
    for priority in sorted({h[2].priority for h in hits}):
        level = [h for h in hits if h[2].priority == priority]
        reach, inside = -1, []
        better = iter(sorted(kept, key=lambda h: h[0]))
        nxt = next(better, None)
        for h in level:  # by start: the furthest end of any better interval that starts no later
            while nxt and nxt[0] <= h[0]:
                reach, nxt = max(reach, nxt[1]), next(better, None)
            if h[1] > reach:
                inside.append(h)
                reach = max(reach, h[1])
        kept += inside
    return sorted(kept, key=lambda h: h[0])


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def base_places(low: bytes) -> tuple[int, list[tuple[int, str]]]:
    """The number of words, and (word position, label) of every base phrase."""
    at = _IS_WORD[np.frombuffer(low, np.uint8)]
    n = int(at[0]) + int(np.count_nonzero(at[1:] & ~at[:-1])) if len(low) else 0
    if b"license" not in low:
        return n, []
    words = _WORD.findall(low)
    found = []
    for label, phrase in BASE_PHRASES.items():
        first, *rest = phrase.encode().split()
        at_word = -1
        while True:
            try:
                at_word = words.index(first, at_word + 1)
            except ValueError:
                break
            if words[at_word + 1 : at_word + 1 + len(rest)] == rest:
                found.append((at_word, label))
    return n, sorted(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of every row."""

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = signatures()
        keywords = automaton(rules)
        for b in pieces(batches):
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
            for text in b["text"].to_pylist():
                raw = (text or "").encode().translate(_FOLD)
                n, places = base_places(raw)
                hits = detect(raw.decode(), rules, keywords)
                base = sorted({x for _, x in places})
                row = (
                    n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base),
                    ",".join(sorted({*base, *(h[2].label for h in hits)})),
                    max([0.5] * bool(places) + [h[2].score for h in hits], default=0.0),
                    [f"{h[2].label}:{h[0]}:{h[1]}" for h in hits],
                )
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([b["id"], *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], names=[id_col, *out])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<string>")
