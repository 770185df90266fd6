"""TypeScript by single lines, for sources that the reader of ts_syntax cannot follow, such as files that were cut off.

Imports come without specifiers, exports without members or docstrings; no name pattern is applied. A line's kind is the
first word of KINDS that it holds anywhere, else const.
"""

from __future__ import annotations

import re

from . import KINDS, Export, Import, Parsed

SOURCE = re.compile(r"from\s+['\"](.+?)['\"]")
NAMED = re.compile(r"export\s+(?:const|let|var|function|class|interface|type|enum)\s+(\w+)", re.A)


def parse(source: str) -> Parsed:
    out = Parsed()
    for number, line in enumerate(map(str.strip, source.split("\n")), 1):
        if line.startswith("import ") and (m := SOURCE.search(line)):
            out.imports.append(Import(m[1], [], number))
        elif line.startswith("export ") and (m := NAMED.search(line)):
            kind = next((k for k in KINDS if k in line), "const")
            out.exports.append(Export(m[1], kind, line.partition("{")[0].rstrip(), line=number))
    return out
