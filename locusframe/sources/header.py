"""VCF headers: parsing, checks, serialisation, and the Spark types that the declared fields have."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

_STRUCTURED = re.compile(r"##(\w+)=<(.*)>\s*$")
_PAIR = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)')
#: The columns that come before FORMAT.
COLUMNS = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
#: Length of a contig that declares none.
UNDECLARED = 2**31 - 1
_TYPES = {"Integer": T.IntegerType(), "Float": T.FloatType(), "Flag": T.BooleanType(), "Character": T.StringType(), "String": T.StringType()}


@dataclass
class Field:
    id: str
    number: str
    type: str
    description: str = ""

    def scalar(self) -> bool:
        return self.number == "1" or self.type == "Flag"

    def spark_type(self) -> T.DataType:
        one = _TYPES[self.type]
        return one if self.scalar() else T.ArrayType(one)


@dataclass
class Header:
    """lines keeps the text of every line but the column line, in order."""

    lines: list[str] = field(default_factory=list)
    contigs: dict[str, int] = field(default_factory=dict)
    info: dict[str, Field] = field(default_factory=dict)
    formats: dict[str, Field] = field(default_factory=dict)
    filters: dict[str, str] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)
    extra: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, lines: Iterable[str]) -> Header:
        """Of header lines up to the column line. Repeated contigs and samples and unknown types are errors."""
        out = cls()
        seen = False
        for line in lines:
            line = line.rstrip("\r\n")
            if line.startswith("##"):
                out.add(line)
            elif line.startswith("#"):
                columns = line[1:].split("\t")
                if columns[:8] != COLUMNS:
                    raise ValueError(f"not a column line: {line[:80]!r}")
                out.samples = columns[9:]
                if len(set(out.samples)) < len(out.samples):
                    raise ValueError("a sample is named twice")
                seen = True
                break
        if not seen:
            raise ValueError("the header has no column line")
        return out

    def add(self, line: str) -> None:
        self.lines.append(line)
        m = _STRUCTURED.match(line)
        if not m:
            key, _, value = line[2:].partition("=")
            self.extra[key] = value
            return
        kind, pairs = m[1], {k: v[1:-1].replace('\\"', '"') if v.startswith('"') else v for k, v in _PAIR.findall(m[2])}
        name = pairs.get("ID", "")
        if kind == "contig":
            if name in self.contigs:
                raise ValueError(f"contig {name!r} is declared twice")
            self.contigs[name] = int(pairs.get("length") or UNDECLARED)
        elif kind in ("INFO", "FORMAT"):
            f = Field(name, pairs.get("Number", "."), pairs.get("Type", "String"), pairs.get("Description", ""))
            if f.type not in _TYPES or kind == "FORMAT" and f.type == "Flag":
                raise ValueError(f"{kind} {name!r} has no type that fits: {f.type!r}")
            (self.info if kind == "INFO" else self.formats).setdefault(name, f)
        elif kind == "FILTER":
            self.filters.setdefault(name, pairs.get("Description", ""))

    def define(self, kind: str, f: Field) -> None:
        """Declare a field. A declaration of the same name with another number or type gives way, as its values do."""
        own = self.info if kind == "INFO" else self.formats
        old = own.get(f.id)
        if old is not None and (old.number, old.type) != (f.number, f.type):
            del own[f.id]
            self.lines = [x for x in self.lines if not re.match(rf"##{kind}=<ID={re.escape(f.id)}[,>]", x)]
        if f.id not in own:
            self.add(f'##{kind}=<ID={f.id},Number={f.number},Type={f.type},Description="{f.description}">')

    def provenance(self, text: str) -> None:
        self.lines.append(f"##locusframe_{text}")

    def text(self, genotypes: bool = True) -> list[str]:
        columns = [*COLUMNS, *(["FORMAT", *self.samples] if genotypes and self.samples else [])]
        return [*self.lines, "#" + "\t".join(columns)]

    def info_type(self) -> T.StructType:
        return T.StructType([T.StructField(f.id, f.spark_type()) for f in self.info.values()])

    def format_type(self) -> T.StructType:
        """Each field is an array over samples. GT is apart."""
        return T.StructType([T.StructField(f.id, T.ArrayType(f.spark_type())) for f in self.formats.values() if f.id != "GT"])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Header:
        d = json.loads(text)
        for k in ("info", "formats"):
            d[k] = {n: Field(**f) for n, f in d[k].items()}
        return cls(**d)
