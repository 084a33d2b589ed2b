"""License scans by ordered signature rules (operator 6).

Each line of ``TABLE`` is a license with hand-written patterns of its title, its grant or characteristic wording, and its address;
with the common forms of a grant and of an SPDX tag that makes some 400 rules.  A rule runs on a text only if its keyword is
there (one Aho-Corasick pass finds the long ones, each text is searched for those of up to three letters), and a grant's
only if some grant's opening words are there.  Overlapping detections are resolved in order: by priority, then by length,
then by place, then by rule number; a detection whose interval lies within that of one already accepted, or equals it, goes.
Detections that merely overlap both stay.

Defined cases: null and empty texts have no detections; texts are scanned whole; rows that share a doc_id are scanned
apart and detections that are alike given once; a null doc_id is kept; an empty table gives an empty result; only doc_id and text
are read.  Positions are in characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from modelgauge.llm import textcore as tc

TAG, GRANT, WORDING, TITLE, ADDRESS, HINT = 60, 50, 40, 30, 20, 10
V = r",?\s*(?:version\s*|v\.?\s*)?"
# license | keyword | title | wording (or -) | address (or -)
TABLE = rf"""
Apache-2.0|apache|apache\s+(?:software\s+)?license{V}2(?:\.0)?|unless\s+required\s+by\s+applicable\s+law\s+or\s+agreed\s+to\s+in\s+writing|apache\.org/licenses/license-2\.0
Apache-1.1|apache|apache\s+(?:software\s+)?license{V}1\.1|this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+apache\s+software\s+foundation|apache\.org/licenses/license-1\.1
Apache-1.0|apache|apache\s+(?:software\s+)?license{V}1\.0|-|apache\.org/licenses/license-1\.0
MIT|license|(?:the\s+)?(?:mit|expat)\s+license|permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy|opensource\.org/licen[sc]es?/mit
MIT-0|mit|mit\s+no\s+attribution(?:\s+license)?|-|opensource\.org/licenses/mit-0
GPL-3.0|general public license|gnu\s+general\s+public\s+license{V}3(?:\.0)?|either\s+version\s+3\s+of\s+the\s+license,\s+or\s+\(at\s+your\s+option\)\s+any\s+later|gnu\.org/licenses/gpl-3\.0
GPL-2.0|general public license|gnu\s+general\s+public\s+license{V}2(?:\.0)?|either\s+version\s+2\s+of\s+the\s+license,\s+or\s+\(at\s+your\s+option\)\s+any\s+later|gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
GPL-1.0|general public license|gnu\s+general\s+public\s+license{V}1(?:\.0)?|-|gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0
LGPL-3.0|lesser general|gnu\s+lesser\s+general\s+public\s+license{V}3(?:\.0)?|-|gnu\.org/licenses/lgpl-3\.0
LGPL-2.1|lesser general|gnu\s+lesser\s+general\s+public\s+license{V}2\.1|-|gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
LGPL-2.0|library general|gnu\s+library\s+general\s+public\s+license{V}2(?:\.0)?|-|gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0
AGPL-3.0|affero|(?:gnu\s+)?affero\s+general\s+public\s+license{V}3(?:\.0)?|remote\s+network\s+interaction;\s+use\s+with\s+the\s+gnu\s+general\s+public|gnu\.org/licenses/agpl
AGPL-1.0|affero|affero\s+general\s+public\s+license{V}1(?:\.0)?|-|affero\.org/oagpl
GFDL-1.3|free documentation|gnu\s+free\s+documentation\s+license{V}1\.3|-|gnu\.org/licenses/fdl-1\.3
GFDL-1.2|free documentation|gnu\s+free\s+documentation\s+license{V}1\.2|-|gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2
BSD-2-Clause|bsd|(?:simplified|freebsd|2-clause|two-clause)\s+bsd\s+license|-|opensource\.org/licenses/bsd-2-clause
BSD-3-Clause|bsd|(?:new|modified|revised|3-clause|three-clause)\s+bsd\s+license|neither\s+the\s+name\s+of\s+.{{1,80}}\s+nor\s+the\s+names\s+of\s+its\s+contributors|opensource\.org/licenses/bsd-3-clause
BSD-4-Clause|bsd|(?:original|4-clause|four-clause)\s+bsd\s+license|all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software|opensource\.org/licenses/bsd-4-clause
0BSD|bsd|(?:zero-clause|0-clause|free\s+public)\s+bsd\s+license|-|opensource\.org/licenses/0bsd
ISC|isc|(?:the\s+)?isc\s+license|permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose|opensource\.org/licenses/isc
MPL-2.0|mozilla|mozilla\s+public\s+license{V}2(?:\.0)?|subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+license|mozilla\.org/mpl/2\.0
MPL-1.1|mozilla|mozilla\s+public\s+license{V}1\.1|-|mozilla\.org/mpl/(?:mpl-)?1\.1
MPL-1.0|mozilla|mozilla\s+public\s+license{V}1\.0|-|mozilla\.org/mpl/(?:mpl-)?1\.0
EPL-2.0|eclipse|eclipse\s+public\s+license(?:\s+-)?{V}2(?:\.0)?|-|eclipse\.org/legal/epl-2\.0
EPL-1.0|eclipse|eclipse\s+public\s+license(?:\s+-)?{V}1(?:\.0)?|-|eclipse\.org/legal/epl-v10
EDL-1.0|eclipse|eclipse\s+distribution\s+license(?:\s+-)?{V}1\.0|-|eclipse\.org/org/documents/edl
CDDL-1.0|development and distribution|common\s+development\s+and\s+distribution\s+license(?:\s+\(cddl\))?{V}1\.0|-|opensource\.org/licenses/cddl-1\.0
CDDL-1.1|development and distribution|common\s+development\s+and\s+distribution\s+license(?:\s+\(cddl\))?{V}1\.1|-|glassfish\.(?:java\.net|dev\.java\.net)/public/cddl
CPL-1.0|common public|common\s+public\s+license{V}1\.0|-|opensource\.org/licenses/cpl1?\.0
CC0-1.0|cc0|cc0{V}1\.0(?:\s+universal)?|to\s+the\s+extent\s+possible\s+under\s+law,?\s+.{{1,60}}\s+has\s+waived|creativecommons\.org/publicdomain/zero/1\.0
CC-BY-4.0|4.0|(?:cc[\s-]by[\s-]4\.0|creative\s+commons\s+attribution\s+4\.0(?:\s+international)?)|-|creativecommons\.org/licenses/by/4\.0
CC-BY-3.0|3.0|(?:cc[\s-]by[\s-]3\.0|creative\s+commons\s+attribution\s+3\.0(?:\s+unported)?)|-|creativecommons\.org/licenses/by/3\.0
CC-BY-2.5|2.5|(?:cc[\s-]by[\s-]2\.5|creative\s+commons\s+attribution\s+2\.5)|-|creativecommons\.org/licenses/by/2\.5
CC-BY-2.0|2.0|(?:cc[\s-]by[\s-]2\.0|creative\s+commons\s+attribution\s+2\.0)|-|creativecommons\.org/licenses/by/2\.0
CC-BY-SA-4.0|4.0|(?:cc[\s-]by-sa[\s-]4\.0|attribution-sharealike\s+4\.0(?:\s+international)?)|-|creativecommons\.org/licenses/by-sa/4\.0
CC-BY-SA-3.0|3.0|(?:cc[\s-]by-sa[\s-]3\.0|attribution-sharealike\s+3\.0(?:\s+unported)?)|-|creativecommons\.org/licenses/by-sa/3\.0
CC-BY-SA-2.0|2.0|(?:cc[\s-]by-sa[\s-]2\.0|attribution-sharealike\s+2\.0)|-|creativecommons\.org/licenses/by-sa/2\.0
CC-BY-NC-4.0|4.0|(?:cc[\s-]by-nc[\s-]4\.0|attribution-noncommercial\s+4\.0(?:\s+international)?)|-|creativecommons\.org/licenses/by-nc/4\.0
CC-BY-NC-3.0|3.0|(?:cc[\s-]by-nc[\s-]3\.0|attribution-noncommercial\s+3\.0(?:\s+unported)?)|-|creativecommons\.org/licenses/by-nc/3\.0
CC-BY-NC-SA-4.0|4.0|(?:cc[\s-]by-nc-sa[\s-]4\.0|attribution-noncommercial-sharealike\s+4\.0)|-|creativecommons\.org/licenses/by-nc-sa/4\.0
CC-BY-NC-SA-3.0|3.0|(?:cc[\s-]by-nc-sa[\s-]3\.0|attribution-noncommercial-sharealike\s+3\.0)|-|creativecommons\.org/licenses/by-nc-sa/3\.0
CC-BY-ND-4.0|4.0|(?:cc[\s-]by-nd[\s-]4\.0|attribution-noderivatives\s+4\.0)|-|creativecommons\.org/licenses/by-nd/4\.0
CC-BY-NC-ND-4.0|4.0|(?:cc[\s-]by-nc-nd[\s-]4\.0|attribution-noncommercial-noderivatives\s+4\.0)|-|creativecommons\.org/licenses/by-nc-nd/4\.0
CC-BY-NC-ND-3.0|3.0|(?:cc[\s-]by-nc-nd[\s-]3\.0|attribution-noncommercial-noderivs\s+3\.0)|-|creativecommons\.org/licenses/by-nc-nd/3\.0
BSL-1.0|boost|boost\s+software\s+license(?:\s+-)?{V}1\.0|-|boost\.org/license_1_0
Zlib|zlib|(?:the\s+)?zlib(?:/libpng)?\s+license|this\s+software\s+is\s+provided\s+'as-is',\s+without\s+any\s+express\s+or\s+implied\s+warranty|zlib\.net/zlib_license
Unlicense|unlicense|the\s+unlicense|this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain|unlicense\.org
WTFPL|public license|do\s+what\s+the\s+fuck\s+you\s+want\s+to\s+public\s+license|-|wtfpl\.net
Artistic-2.0|artistic|artistic\s+license{V}2(?:\.0)?|-|opensource\.org/licenses/artistic-2\.0
Artistic-1.0|artistic|artistic\s+license{V}1\.0|-|opensource\.org/licenses/artistic-1\.0
PSF-2.0|license|(?:python\s+software\s+foundation|psf)\s+license(?:\s+agreement)?(?:{V}2)?|-|docs\.python\.org/\d?/?license
PostgreSQL|postgresql|(?:the\s+)?postgresql\s+licen[sc]e|-|opensource\.org/licenses/postgresql
OpenSSL|openssl|(?:the\s+)?openssl\s+license|this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+openssl\s+project|openssl\.org/source/license
PHP-3.01|php|(?:the\s+)?php\s+license{V}3\.01|-|php\.net/license/3_01
Ruby|ruby|ruby\s+license|-|ruby-lang\.org/en/about/license
NCSA|illinois|university\s+of\s+illinois(?:/ncsa)?\s+open\s+source\s+license|-|opensource\.org/licenses/ncsa
EUPL-1.2|european union|european\s+union\s+public\s+licen[cs]e{V}1\.2|-|joinup\.ec\.europa\.eu/.{{0,40}}eupl
EUPL-1.1|european union|european\s+union\s+public\s+licen[cs]e{V}1\.1|-|-
MS-PL|microsoft|microsoft\s+public\s+license|-|opensource\.org/licenses/ms-pl
MS-RL|microsoft|microsoft\s+reciprocal\s+license|-|opensource\.org/licenses/ms-rl
OFL-1.1|open font|sil\s+open\s+font\s+license{V}1\.1|-|scripts\.sil\.org/ofl
BUSL-1.1|business source|business\s+source\s+license{V}1\.1|-|mariadb\.com/bsl11
SSPL-1.0|server side|server\s+side\s+public\s+license{V}1(?:\.0)?|-|mongodb\.com/licensing/server-side-public-license
Elastic-2.0|elastic|elastic\s+license{V}2(?:\.0)?|-|elastic\.co/licensing/elastic-license
ODbL-1.0|open database|open\s+(?:data\s+commons\s+)?database\s+license(?:\s+\(odbl\))?(?:{V}1\.0)?|-|opendatacommons\.org/licenses/odbl
ODC-By-1.0|open data commons|open\s+data\s+commons\s+attribution\s+license(?:{V}1\.0)?|-|opendatacommons\.org/licenses/by
PDDL-1.0|public domain dedication|public\s+domain\s+dedication\s+and\s+license(?:{V}1\.0)?|-|opendatacommons\.org/licenses/pddl
UPL-1.0|universal permissive|universal\s+permissive\s+license{V}1\.0|-|opensource\.org/licenses/upl
AFL-3.0|academic free|academic\s+free\s+license{V}3\.0|-|opensource\.org/licenses/afl-3\.0
OSL-3.0|open software|open\s+software\s+license{V}3\.0|-|opensource\.org/licenses/osl-3\.0
CECILL-2.1|cecill|cecill{V}2\.1|-|cecill\.info/licences/licence_cecill_v2\.1
Vim|vim|vim\s+license|-|vimhelp\.org/uganda
W3C|w3c|w3c\s+software\s+(?:notice\s+and\s+)?license|-|w3\.org/consortium/legal/\d{{4}}/copyright-software
HPND|historical permission|historical\s+permission\s+notice\s+and\s+disclaimer|-|opensource\.org/licenses/hpnd
"""
HINTS = (  # a license of unknown version or name
    ("GPL", "general public license", r"gnu\s+general\s+public\s+license"),
    ("GPL", "gnu", r"gnu\s+gpl"),
    ("LGPL", "lesser general", r"gnu\s+lesser\s+general\s+public\s+license"),
    ("AGPL", "affero", r"affero\s+general\s+public\s+license"),
    ("Apache", "apache", r"apache\s+(?:software\s+)?license"),
    ("BSD", "bsd", r"bsd(?:-style)?\s+license"),
    ("CC", "creative commons", r"creative\s+commons\s+(?:public\s+)?licen[sc]e"),
    ("Public-Domain", "public domain", r"(?:released|placed|dedicated)\s+(?:in)?to\s+the\s+public\s+domain"),
    ("Proprietary", "proprietary", r"proprietary\s+and\s+confidential|proprietary\s+license"),
    ("All-Rights-Reserved", "rights reserved", r"all\s+rights\s+reserved"),
)
_GRANT = r"(?:this\s+\w+\s+is\s+)?(?:licen[sc]ed|released|distributed|available|provided)\s+(?:under|subject\s+to)\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?"
_ANY_GRANT = re.compile(r"(?:licen[sc]ed|released|distributed|available|provided)\s+(?:under|subject\s+to)\s")  # every grant has it


@dataclass(frozen=True)
class Rule:
    number: int
    license: str
    kind: str
    priority: int
    keyword: str
    pattern: re.Pattern


def _rules() -> tuple[Rule, ...]:
    out: list[Rule] = []

    def add(license_: str, kind: str, priority: int, keyword: str, pattern: str) -> None:
        out.append(Rule(len(out), license_, kind, priority, keyword, re.compile(rf"(?<![^\W_])(?:{pattern})(?![^\W_])", re.S)))

    for line in TABLE.strip().split("\n"):
        head, keyword, title, wording, address = _cut(line)
        spdx = re.escape(head.lower())
        later = r"(?:-only|-or-later|\+)?" if "GPL" in head or "GFDL" in head else ""
        add(head, "tag", TAG, "spdx", rf"spdx-license-identifier:\s*{spdx}{later}")
        add(head, "grant", GRANT, keyword, _GRANT + f"(?:{title})")
        add(head, "grant", GRANT, head.lower().split("-")[0], _GRANT + spdx + later)
        add(head, "title", TITLE, keyword, title)
        if wording != "-":
            add(head, "wording", WORDING, max(re.findall("[a-z]{4,}", wording), key=len), wording)
        if address != "-":
            add(head, "address", ADDRESS, re.split(r"[\\(/]", address)[0], f"(?:https?://)?(?:www\\.)?{address}")
    for name, keyword, pattern in HINTS:
        add(name, "hint", HINT, keyword, pattern)
    return tuple(out)


def _cut(s: str) -> list[str]:
    """The fields of a line: bars within parentheses belong to a pattern."""
    out, depth = [""], 0
    for c in s:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


RULES = _rules()


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections (begin, end, rule) without those that lie within a stronger one."""
    kept: list[tuple[int, int, Rule]] = []
    for b, e, r in sorted(set(found), key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].number)):
        if not any(kb <= b and e <= ke for kb, ke, _ in kept):
            kept.append((b, e, r))
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].number))


def detect(low: str, keywords: set[str]) -> list[tuple[int, int, Rule]]:
    """Detections in a lower-case text that has these keywords."""
    granted = _ANY_GRANT.search(low) is not None
    return resolve([(m.start(), m.end(), r) for r in RULES if r.keyword in keywords and (granted or r.kind != "grant") for m in r.pattern.finditer(low)])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gate = ahocorasick.Automaton()
    for k in {r.keyword for r in RULES}:
        if len(k) > 3:
            gate.add_word(k, k)
    gate.make_automaton()
    short = {r.keyword for r in RULES if len(r.keyword) <= 3}
    for part, texts in tc.slices(batches):
        ids, rows = [], []
        for doc, text in zip(part.column(0).to_pylist(), texts):
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text) if "İ" in text else text.lower()
            flat = " ".join(low.split())  # a keyword of several words may go over a line's end
            for b, e, r in detect(low, {k for _, k in gate.iter(flat)} | {k for k in short if k in flat}):
                ids.append(doc)
                rows.append((r.number, r.license, r.kind, b, e))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["doc_id", "rule", "license", "kind", "begin_char", "end_char"])


def licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, rule, license, kind, begin_char, end_char) of each detection that is left."""
    return tc.ids_texts(docs).mapInArrow(_scan, "doc_id bigint, rule int, license string, kind string, begin_char bigint, end_char bigint").distinct()
