"""Source files that nobody of the project wrote by hand: generated, minified, vendored, or data saved as code.

Each file is read once. A multi-pattern automaton looks for generation notices and for licences of published code in
the comments that open and close the file (a notice inside code, say in a generator's banner string, says nothing
about the file itself). A notice counts where a sentence of the comment begins. Path rules know vendored and generated
directories, lockfiles and minified suffixes. The shape of the code without its literals tells minified code and mere
data.

A licence alone doesn't make a file foreign, as projects license their own code. A header that states one is foreign
if it names what the file comes from (a package with its version, an authors' collective, an upstream), or a copyright
holder other than the repository's own, which is the one that more than half of its files name; what the repository's
own header names isn't foreign. Of directories, `gen`, `external` and `deps` count at the root of a repository only,
`external` and `deps` only for packages that no other path of the repository mentions; elsewhere they take a licence
with them.

Last, copies of third-party code that lost their header are known by their blocks: code blocks of files found to be
third-party are matched by hash, and a file most of whose blocks are among them is a copy.

Definitions: code of fewer than 40 characters is too little to be data or minified, code of fewer than 200 characters
without its literals too little to be minified, and a block is a paragraph of code of 60 characters or more.

Defined results: null or empty content (or nothing but white space) is no case; a null repository is a value; a null
path matches no path rule; repeated deliveries of a file count once, as a case if any of them is one; both path
separators and line ends count alike; contents are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.common import small, stage

#: Notices, in lower case, with which a sentence begins, perhaps after "this file is" or the like.
NOTICES = [
    "code generated", "file generated", "@generated", "<auto-generated", "auto-generated", "autogenerated", "auto generated", "automatically generated", "automatically created", "generated automatically",
    "created automatically", "written automatically", "machine generated", "machine-generated", "machine written", "machine-written", "generated file", "generated code", "generated source",
    "generated by ", "generated from ", "generated with ", "generated using ", "generated on ", "autogen", "do not edit by hand", "do not edit this file", "do not edit manually", "do not modify this file",
    "do not modify by hand", "do not modify manually", "any manual changes", "manual changes will be", "changes to this file will be lost", "changes will be lost", "changes will be overwritten",
]
#: What states a licence.
LICENCES = [
    "@license", "@licence", "licensed under", "released under", "distributed under", "available under", "permission is hereby granted", "redistribution and use in source and binary forms", "spdx-license-identifier:",
]
#: What names an origin outside the project: anywhere, or where a sentence begins.
ORIGINS = ["upstream release", "upstream version", "upstream archive", "upstream source", "upstream repository"]
ORIGINS_AT_START = ["vendored from", "vendored copy", "copied from", "forked from", "taken from", "imported from upstream", "originally from", "originally published"]
_SUBJECT = re.compile(r"(?:^|[.;:!?,]\s+|--?\s+|—\s*|\*\s+)(?:(?:this|the) (?:\w+ )?(?:file|code|module|source|script|class|header) (?:is|was|has been|were) )?(?:an? )?$")
#: Licences by their short names, which name no package.
_LICENCE_NAME = re.compile(r"(?i)^(mit|isc|zlib|unlicense|cc0|public domain|wtfpl|proprietary|commercial|(apache|bsd|gpl|lgpl|agpl|mpl|epl|artistic|boost|bsl|python|licenseref)\b.*)")
_TAGGED = re.compile(r"(?i)@licen[sc]e:?\s+(\S.*)$")
_VERSIONED = re.compile(r"(?i)^(?:package |module |library )?([\w@][\w.@/-]*),?\s+(?:upstream )?(?:v|version |release )?\d+(?:\.\d+)+")
_HOLDER = re.compile(r"(?i)(?:copyright|\(c\)|©)[\s:,-]*(?:\(c\)|©)?\s*(?:\d{4}(?:\s*[-–,]\s*(?:\d{4}|present))*,?)?\s*(?:by\s+)?([^\d\W][^.;|]*?)\s*(?:,?\s*(?:all rights reserved|released under|licensed under|and (?:other|its) contributors).*)?$")
_COLLECTIVE = re.compile(r"(?i)\b(contributors|authors|developers|maintainers|foundation|project)$")
VENDORED = {"vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "site-packages"}
#: Directories that often hold foreign code, but may hold the project's own.
OFTEN_VENDORED = {"external", "externals", "deps"}
GENERATED = {"generated", "__generated__", "autogen", "autogenerated"}
OFTEN_GENERATED = {"gen"}
GENERATED_NAME = re.compile(r"(_pb2(_grpc)?\.pyi?|_pb\.(js|ts|d\.ts)|\.pb\.(go|cc|h|dart)|\.(g|gen|generated|freezed|designer)\.[a-z]+)$")
MINIFIED_NAME = re.compile(r"([.-]min\.(js|css|mjs)|\.(bundle|chunk|packed)\.js|\.[0-9a-f]{6,32}\.(js|css|mjs))$")
LOCKFILES = {"package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "poetry.lock", "pipfile.lock", "go.sum", "composer.lock", "gemfile.lock", "uv.lock"}

#: Share of a file's code blocks that must be third-party.
COPIED_SHARE = 0.6
BLOCK_CHARS = 60

_LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`|\b0[xX][0-9a-fA-F]+\b|(?<![\w])-?\d[\d_.]*(?:[eE][+-]?\d+)?')
_CODE = re.compile(r"\b(function|func|fn|def|class|interface|return|if|for|while|switch|lambda|struct|impl|trait|enum|async|import|from|use|package)\b|=>|->")
_PREAMBLE = re.compile(r"\s*(#!|package\b|['\"]use strict|<\?|# -\*-|\"\"\"|''')")


def split_comments(text: str) -> tuple[list[str], list[str], str]:
    """Comment lines that open the file, those that close it, and the code without whole-line comments."""
    kinds: list[tuple[bool, str]] = []
    block = ""
    for line in text.split("\n"):
        s = line.strip()
        if block:
            kinds.append((True, s))
            if block in s:
                block = ""
        elif not s:
            kinds.append((True, ""))
        elif s.startswith("/*") or s.startswith("<!--"):
            end = "*/" if s.startswith("/*") else "-->"
            rest = s.partition(end)[2].strip()
            kinds.append((not rest, s))
            block = "" if end in s else end
        elif s.startswith(("//", "#", "--", ";", "%")) and not s.startswith(("#include", "#define", "#[", "#!/")) or s.startswith("* ") or s == "*":
            kinds.append((True, s))
        else:
            kinds.append((False, line))
    head: list[str] = []
    skipped = 0
    for comment, s in kinds:
        if not comment:
            if skipped < 3 and _PREAMBLE.match(s):
                skipped += 1
                head.append(s)
                continue
            break
        head.append(s)
    tail = []
    for comment, s in reversed(kinds):
        if not comment:
            break
        tail.append(s)
    return head, tail, "\n".join(s for comment, s in kinds if not comment)


def _automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for kind, phrases in (("notice", NOTICES), ("licence", LICENCES), ("origin", ORIGINS), ("start", ORIGINS_AT_START)):
        for p in phrases:
            auto.add_word(p, (kind, len(p)))
    auto.make_automaton()
    return auto


_AUTO: list = []
_MARKS = re.compile(r"^[\s/#*!;%\-\"']+|(?:\*/|-->)?\s*$")
_EDIT = re.compile(r"(?:^|[.;:!?,]\s+|--?\s+)do not (?:edit|modify)[\s.!*]*$")


@dataclass
class Header:
    """What a file's opening and closing comments say."""

    generated: bool = False
    licensed: bool = False
    #: Comes from elsewhere for certain.
    foreign: bool = False
    #: Names a package or a collective, which may be the repository's own.
    named: bool = False
    holder: str | None = None


def read_header(head: list[str], tail: list[str]) -> Header:
    if not _AUTO:
        _AUTO.append(_automaton())
    out = Header()
    for place, lines in (("head", head), ("tail", tail)):
        for line in lines:
            if not line:
                continue
            text = _MARKS.sub("", line).strip()
            low = text.lower()
            for stop, (kind, n) in _AUTO[0].iter(low):
                begins = kind in ("notice", "start") and _SUBJECT.search(low[: stop - n + 1])
                if kind == "notice" and begins:
                    out.generated = True
                elif place == "head" and (kind == "origin" or kind == "start" and begins):
                    out.foreign = True
                elif place == "head" and kind == "licence":
                    out.licensed = True
            if _EDIT.search(low):
                out.generated = True
            if place == "head":
                tagged = _TAGGED.search(text)
                if tagged and not _LICENCE_NAME.match(tagged[1]):
                    out.named, out.holder = True, out.holder or tagged[1].strip().lower()
                versioned = _VERSIONED.match(text)
                if versioned and versioned[1].lower() not in ("version", "v", "release", "copyright"):
                    out.named, out.holder = True, out.holder or versioned[1].lower()
                holder = _HOLDER.search(text)
                if holder:
                    out.holder = holder[1].strip(" ,").lower()
                    out.named = out.named or bool(_COLLECTIVE.search(out.holder))
    return out


def path_evidence(path: str | None) -> tuple[str | None, str | None]:
    """What the path says for certain; and the package below a directory at the root that often holds foreign code."""
    if not path:
        return None, None
    parts = path.replace("\\", "/").lower().strip("/").split("/")
    dirs, name = parts[:-1], parts[-1]
    if VENDORED & set(dirs):
        return "third-party", None
    if GENERATED & set(dirs) or OFTEN_GENERATED & set(dirs[:1]) or GENERATED_NAME.search(name):
        return "generated", None
    if MINIFIED_NAME.search(name):
        return "minified", None
    if name in LOCKFILES:
        return "generated", None
    return None, (dirs[1] if len(dirs) > 1 else name.split(".")[0]) if OFTEN_VENDORED & set(dirs[:1]) else None


def shape_evidence(code: str) -> str | None:
    """'minified' for code squeezed into long lines, 'data' for literals without code around them."""
    body = code.strip()
    if len(body) < 40:
        return None
    bare = _LITERAL.sub("", body)
    literal = 1 - len(bare) / len(body)
    if literal >= 0.5 and not _CODE.search(bare):
        return "data"
    lines = [x for x in bare.split("\n") if x.strip()]
    if len(bare) >= 200 and len(bare) / max(1, len(lines)) > 120 and sum(c.isspace() for c in bare) < 0.09 * len(bare):
        return "minified"
    return None


def block_hashes(code: str) -> list[int]:
    out = set()
    for b in re.split(r"\n[ \t]*\n", code):
        b = " ".join(b.split())
        if len(b) >= BLOCK_CHARS:
            out.add(int.from_bytes(hashlib.blake2b(b.encode(), digest_size=8).digest(), "big", signed=True))
    return sorted(out)


@dataclass
class Judgement:
    """Of a file by itself: what is certain, what the rest of the repository decides, and its code blocks."""

    reason: str | None
    #: What holds if the header turns out not to be foreign.
    otherwise: str | None
    licensed: bool
    named: bool
    holder: str | None
    package: str | None
    blocks: list[int]


def judge(path: str | None, content: str) -> Judgement:
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    head, tail, code = split_comments(text)
    header = read_header(head, tail)
    certain, package = path_evidence(path)
    dirs = set((path or "").replace("\\", "/").lower().split("/")[:-1])
    if header.licensed and dirs & OFTEN_VENDORED:
        certain = certain or "third-party"
    otherwise = certain or shape_evidence(code)
    reason = "generated" if header.generated else "third-party" if header.foreign else None
    return Judgement(reason, otherwise, header.licensed, header.named, header.holder, None if certain else package, block_hashes(code))


_FIELDS = {"repository": "string", "path": "string", "reason": "string", "otherwise": "string", "licensed": "boolean", "named": "boolean", "holder": "string", "package": "string", "blocks": "array<bigint>"}


def _signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
    for batch in batches:
        repos, paths, contents = (c.to_pylist() for c in batch.columns)
        got = [judge(p, c) for p, c in zip(paths, contents)]
        columns = [repos, paths] + [[getattr(g, name) for g in got] for name in list(_FIELDS)[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, kind in zip(columns, _FIELDS.values())], list(_FIELDS))


def not_handwritten(files: DataFrame, share: float = COPIED_SHARE) -> DataFrame:
    """(repository, path, reason) of files nobody wrote by hand: generated, third-party, minified, data or copied."""
    real = files.where("content IS NOT NULL AND content RLIKE '\\\\S'").select("repository", "path", "content")
    read = stage(real.mapInArrow(_signals, ", ".join(f"{k} {v}" for k, v in _FIELDS.items())), "signals")
    # a null repository is one of its own
    read = read.withColumn("repo", F.coalesce(F.concat(F.lit("="), "repository"), F.lit("?")))
    size = read.groupBy("repo").agg(F.countDistinct("path").alias("files"))
    held = read.where("holder IS NOT NULL").groupBy("repo", "holder").agg(F.countDistinct("path").alias("n"))
    own = held.join(size, "repo").where(F.col("n") * 2 > F.col("files")).select("repo", F.col("holder").alias("own"))
    # packages below `external` and the like that the repository mentions elsewhere are its own
    asked = read.where("package IS NOT NULL").select("repo", "package").distinct()
    parts = F.explode(F.split(F.lower(F.translate("path", "\\", "/")), "[/.]")).alias("package")
    mentioned = read.where("package IS NULL").select("repo", parts).join(small(asked), ["repo", "package"], "left_semi").distinct().withColumn("mentioned", F.lit(True))
    other = F.col("own").isNotNull() & (F.col("holder") != F.col("own"))
    foreign = F.col("licensed") & (F.coalesce(other, F.lit(False)) | F.col("named") & (F.col("own").isNull() | ~F.col("own").eqNullSafe(F.col("holder"))))
    beside = F.col("package").isNotNull() & F.col("mentioned").isNull()
    reason = F.coalesce("reason", F.when(foreign, "third-party"), "otherwise", F.when(beside, "third-party"))
    signals = read.join(small(own), "repo", "left").join(small(mentioned), ["repo", "package"], "left").select("repository", "path", reason.alias("reason"), "blocks")
    known = signals.where("reason = 'third-party'").select(F.explode("blocks").alias("block")).distinct()
    # One row per file and version; a null path or repository is a value.
    rest = signals.where("reason IS NULL AND size(blocks) > 0").withColumn("file", F.xxhash64(F.to_json(F.struct("repository", "path"), {"ignoreNullFields": "false"}), F.to_json("blocks")))
    found_blocks = (
        rest.select("file", F.explode("blocks").alias("block")).distinct().join(known, "block", "left_semi").groupBy("file").agg(F.count(F.lit(1)).alias("hits"))
    )
    copied = rest.join(found_blocks, "file").where(F.col("hits") >= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.size("blocks")))).select("repository", "path", F.lit("copied").alias("reason"))
    found = signals.where("reason IS NOT NULL").select("repository", "path", "reason").unionByName(copied)
    return found.groupBy("repository", "path").agg(F.min("reason").alias("reason"))
