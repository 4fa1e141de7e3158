import pytest

from stratalens.llm.handwritten import judge, not_handwritten

APACHE = "// Licensed under the Apache License, Version 2.0\n"

CODE = "import x\n\n// keep the order stable\nfunction fold(edge, n) {\n  const limit = n ?? 4;\n  return edge.slice(limit, n + 2);\n}\n\nexport function unfold(span) {\n  return span.map((x) => x.weight * 3 + fold(x, 2));\n}\n"
OTHER = CODE.replace("fold", "load").replace("weight", "height").replace("slice", "find")
DATA = "export const t = [\n" + "\n".join(f'  {{"k": "a-{i}", "x": {i}.5}},' for i in range(40)) + "\n];\n"
MIN = "/*! x v1.2.3 */\n" + "!function(a,b){c.on(d,e)}(window);if(f===g)for(;h;)i.push(j);" * 12
BLOB = 'var t = "' + "aB3/x9Kq" * 90 + '"\n'
OWN = "// Copyright (c) the Home Team. All rights reserved.\n// SPDX-License-Identifier: LicenseRef-Home\n"


@pytest.mark.parametrize(
    "path, content, why",
    [
        ("src/a.ts", CODE, None), ("src/a.ts", OWN + CODE, None), ("src/a.ts", "// Code generated by x. DO NOT EDIT.\n" + CODE, "generated"), ("src/a.ts", OWN + "//\n//\n// @generated by x\n" + CODE, "generated"),
        ("src/a.ts", CODE + "// machine written by x\n", "generated"), ("src/a.ts", CODE + 'const banner = "// @generated";\n', None),
        ("src/a.py", "# do not edit the cursor after a flush\n" + CODE, None), ("src/a.py", "# the id is generated by the server\n" + CODE, None), ("src/a.java", "/*\n * This file was generated from a schema.\n * Do not edit.\n */\n" + CODE, "generated"),
        ("src/a.ts", "// @license foo\n" + CODE, "third-party"), ("lib\\Vendor\\foo\\a.ts", CODE, "third-party"), ("src/vendors/a.ts", CODE, None), ("src/vendor_portal/a.ts", CODE, None),
        ("src/generated/a.ts", CODE, "generated"), ("src/a_pb2.py", CODE, "generated"), ("src/pb_mapper.py", CODE, None), ("src/generated_at.ts", CODE, None), ("src/a.min.js", CODE, "minified"), ("src/min_stock.js", CODE, None),
        ("src/a.js", MIN, "minified"), ("src/a.js", DATA, "data"), ("src/a.go", BLOB, "data"), ("src/a.js", CODE + "const q = 'select " + "a.b, " * 200 + "c';\n", None), ("yarn.lock", CODE, "generated"), (None, CODE, None),
        ("src/a.ts", CODE.replace("\n", "\r\n"), None), ("src/a.ts", ("// Generated from definitions.\n" + CODE).replace("\n", "\r\n"), "generated"),
    ],
)
def test_evidence(path, content, why):
    assert alone(path, content) == why


def alone(path, content):
    """What comes out for a file whose repository says nothing."""
    got = judge(path, content)
    return got.reason or ("third-party" if got.licensed and got.named else None) or got.otherwise or ("third-party" if got.package else None)


@pytest.mark.parametrize(
    "path, content, why",
    [
        ("src/a.ts", "// Copyright 2024 Home Inc.\n" + APACHE + CODE, None), ("src/a.ts", "// SPDX-License-Identifier: MIT\n" + CODE, None), ("src/a.ts", "// @license MIT\n" + CODE, None),
        ("src/a.ts", "// Distributed under the terms of our licence; written by hand\n" + CODE, None), ("src/a.py", "# Handles requests to regenerate after a failed build\n" + CODE, None),
        ("src/a.py", "# Upstream archive jobs are scheduled here\n" + CODE, "third-party"), ("src/deps/graph.py", CODE, None), ("src/gen/random_walk.py", CODE, None), ("lib/external/client.py", CODE, None),
        ("lib/external/client.py", "# (c) Foo\n# Released under the MIT License\n" + CODE, "third-party"), ("external/fooish/client.py", CODE, "third-party"), ("gen/a.ts", CODE, "generated"),
        ("src/a.ts", "// wobble v1.2.3\n// (c) the wobble contributors, released under the MIT License\n" + CODE, "third-party"), ("src/a.ts", "// wobble v1.2.3\n" + CODE, None),
        ("src/a.ts", "// Vendored from https://example.org/x\n" + CODE, "third-party"), ("src/a.ts", "// values copied from the old config\n" + CODE, None), ("src/a.ts", "// This module is auto-generated; see x\n" + CODE, "generated"),
        ("src/a.ts", "// tells whether a row is auto-generated\n" + CODE, None), ("src/a.ts", "/* Do not edit. */\n" + CODE, "generated"), ("src/a.ts", "// people do not edit\n" + CODE, None),
    ],
)
def test_what_speaks_for_and_against(path, content, why):
    assert alone(path, content) == why


def test_the_repositorys_own_header_is_no_evidence(spark):
    own, other = "// Copyright 2024 The Home Authors\n" + APACHE, "// Copyright (c) 2019 Jane Doe\n// Licensed under the MIT License\n"
    mine = [("home", f"src/m{i}.ts", own.replace("2024", str(2020 + i)) + CODE.replace("fold", f"fold{i}")) for i in range(9)]
    rows = mine + [("home", "src/bare.ts", OTHER), ("home", "src/foreign.ts", other + OTHER.replace("load", "bold")), ("away", "src/foreign.ts", own + CODE.replace("fold", "hold")), ("away", "src/a.ts", OTHER.replace("load", "told"))]
    rows += [("home", "external/payments/client.ts", CODE.replace("fold", "paid")), ("home", "src/payments/a.ts", CODE.replace("fold", "pay")), ("home", "deps/fooish/a.ts", CODE.replace("fold", "foo")), ("home", "deps/fooish/b.ts", CODE.replace("fold", "bar"))]
    df = spark.createDataFrame(rows, "repository string, path string, content string")
    got = {(r.repository, r.path): r.reason for r in not_handwritten(df).collect()}
    assert got == {(r, p): "third-party" for r, p in (("home", "src/foreign.ts"), ("away", "src/foreign.ts"), ("home", "deps/fooish/a.ts"), ("home", "deps/fooish/b.ts"))}


def test_copies_without_header_and_dirt(spark):
    big = "// @generated\n" + CODE * 4000
    rows = [
        ("r", "vendor/foo/a.ts", "// @license foo\n" + CODE), ("q", "src/copy.ts", CODE.replace("\n", "\r\n")), ("q", "src/other.ts", OTHER), ("q", "src/part.ts", OTHER + "\n" + CODE.split("\n\n")[1] + "\n"),
        ("q", "src/empty.ts", ""), ("q", "src/null.ts", None), ("q", "src/blank.ts", " \n"), ("r", "src/x.js", DATA), ("r", "src/x.js", DATA), (None, "src/y.js", DATA), ("r", None, DATA), ("r", "src/big.ts", big),
    ]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "repository string, path string, content string, block long, reason string")
    got = sorted(tuple(r) for r in not_handwritten(df).collect() if r.path and r.repository)
    assert got == [("q", "src/copy.ts", "copied"), ("r", "src/big.ts", "generated"), ("r", "src/x.js", "data"), ("r", "vendor/foo/a.ts", "third-party")]
    assert not_handwritten(df).count() == 6 and not_handwritten(df.limit(0)).count() == 0
