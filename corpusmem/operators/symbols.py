"""Declarations in source code, line by line, from one rule table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmem.functions.text import mangled, trim


@dataclass(frozen=True)
class Rule:
    """Lines that match are declarations; the name is the group of that number, or `name` if given."""

    pattern: str
    kind: str
    groups: tuple[int, ...] = (1,)
    name: str = ""


# Extensions by language, the words that are no return type, and the declaration patterns.
LANGUAGES = {
    "js": (".js", ".mjs", ".cjs", ".ts", ".jsx", ".tsx"),
    "python": (".py",),
    "go": (".go",),
    "rust": (".rs",),
    "c": (".c", ".cpp", ".cc", ".h", ".hpp", ".cs", ".java"),
    "shell": (".sh", ".zsh"),
}
OTHER_CODE = (".php", ".rb", ".swift", ".kt", ".kts")
CONTROL = ("if", "for", "while", "switch", "catch", "return", "foreach", "using", "lock", "var", "function")
RULES = {
    "js": (
        Rule(r"^export\s+(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", "function"),
        Rule(r"^export\s+(?:default\s+)?(?:async\s+)?class\s+([A-Za-z_$][\w$]*)", "class"),
        Rule(r"^(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(", "function"),
        Rule(r"^(?:export\s+)?class\s+([A-Za-z_$][\w$]*)", "class"),
        Rule(r"^(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(", "function"),
        Rule(r"^(?:export\s+)?(?:async\s+)?function\s*\(", "function", (), "(anonymous)"),
    ),
    "python": (Rule(r"^class\s+(\w+)\s*(?:\(|:)", "class"), Rule(r"^def\s+(\w+)\s*\(", "function"), Rule(r"^async\s+def\s+(\w+)\s*\(", "function")),
    "go": (Rule(r"^func\s+\([^)]*\)\s+(\w+)\s*\(", "method"), Rule(r"^func\s+(\w+)\s*\(", "function"), Rule(r"^type\s+(\w+)\s+(?:struct|interface)\b", "type")),
    "rust": (Rule(r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)\s*\(", "function"), Rule(r"^(?:pub\s+)?(?:struct|enum|trait|impl)\s+(\w+)", "type")),
    "c": (
        Rule(r"^(?:public|private|protected|internal|static|abstract|sealed|partial|\s)*\b(?:class|interface|struct|enum|record)\s+(\w+)", "class"),
        Rule(r"^(?:public|private|protected|internal|static|abstract|virtual|override|sealed|async|unsafe|extern|readonly|ref|partial|\s)*(\b[A-Za-z_]\w*(?:<[^<>]*>)?(?:\s*\[\s*\])?|\([^(){};]*\))\s+([A-Za-z_]\w*)\s*\([^(){};]*\)\s*(?:where\s+[^{;]*?)?\s*(?:;|\{)?\s*$", "function", (2,)),
    ),
    "shell": (Rule(r"^([A-Za-z_]\w*)\s*\(\s*\)", "function"),),
    "other": (Rule(r"^(?:def|func|fn|function)\s+(\w+)", "function"),),
}


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./]*)\z", 1)


def lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_no, raw, line): lines from 1 with comments (from // and from #, in all languages) and blank lines gone."""
    rows = files.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\r?\n")).alias("pos", "raw"))
    bare = F.regexp_replace(F.regexp_replace("raw", F.lit("//.*$"), F.lit("")), F.lit("#.*$"), F.lit(""))
    return rows.select("path", (F.col("pos") + 1).alias("line_no"), "raw", trim(bare).alias("line")).where("line <> ''")


def declaration(line: Column, ext: Column) -> Column:
    """struct(name, kind) of the declaration on a line, or null."""
    def found(language: str) -> Column:
        hits = []
        for rule in RULES[language]:
            if rule.name:
                name = F.when(line.rlike(rule.pattern), rule.name).otherwise("")
            else:
                name = F.regexp_extract(line, rule.pattern, rule.groups[0])
            if rule.groups == (2,):
                name = F.when(F.regexp_extract(line, rule.pattern, 1).isin(*CONTROL), "").otherwise(name)
            kind = F.when(line.contains("impl"), "impl").otherwise("type") if language == "rust" and rule.kind == "type" else F.lit(rule.kind)
            hits.append(F.struct(name.alias("name"), kind.alias("kind")))
        return F.get(F.filter(F.array(*hits), lambda h: h["name"] != ""), F.lit(0))

    out = F
    for language, extensions in LANGUAGES.items():
        out = out.when(ext.isin(*extensions), found(language))
    return out.otherwise(found("other"))


def symbol_entries(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Entries of all declarations in source files, in the schema of document entries."""
    rows = lines(files, path, text).withColumn("d", declaration(F.col("line"), extension(F.col("path")))).where("d is not null")
    name, kind, no = F.col("d.name"), F.col("d.kind"), F.col("line_no").cast("string")
    return rows.select(
        "path", F.col("line_no").alias("seq"), F.concat(mangled(F.col("path")), F.lit("#"), no).alias("id"), F.lit("symbol").alias("type"),
        F.concat(name, F.lit(" ("), kind, F.lit(")")).alias("title"), F.concat(kind, F.lit(' "'), name, F.lit('" declared at '), F.col("path"), F.lit(":"), no).alias("summary"),
        F.array(name, kind).alias("keywords"), F.col("path").alias("source_path"), F.col("line_no").alias("source_line"), F.substring(trim(F.col("raw")), 1, 200).alias("text"),
    )
