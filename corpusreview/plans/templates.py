"""Texts the sample corpus is rendered from: single lines that trigger (or just miss) a rule, and whole Python blocks.

``#N#`` is replaced by a number when a line is rendered.
"""

LINES = (
    "total = 10",
    "total=#N#",
    "ratio = x * 1.25",
    "mask = 0x44 + 55px + 1_000",
    'console.log("step #N#");',
    "var item#N# = load(#N#);",
    "// retry 99 times",
    "# magic 77",
    "/* block 88 */",
    "result = compute_the_total_of_all_items(first_argument, second_argument, third_argument, fourth_argument, fifth, sixth, #N#)",
    "// TODO: handle case #N#",
    "later = 1  // FIXME",
    "                deep(call);",
    'password = "abcdefghij#N#"',
    'api_key =\n    "ABCDEF-12345_67890"',
    "value = eval(expr)",
    "exec(code)",
    "p = subprocess.Popen(cmd, shell=True)",
    'query = "SELECT name FROM users WHERE id = " + user_id',
    "rows_updated = updated + delta",
    "obj = pickle.loads(blob)",
    "cfg = yaml.load(stream)",
    "cfg = yaml.safe_load(stream)",
    "function handle#N#(event, index = 0) {",
    "const onClick#N# = async (event) => {",
    "render(props, get(x)) {",
    "items.map(function (x) { return x; });",
    "class Widget#N# extends Base {",
    "import React from 'react';",
    "const fs = require('fs');",
    "const v = a?.b ?? c;",
    "if (ready && (count > 10 || force)) {",
    "broken(call(",
    "",
    "## Section #N#",
    "- item #N#",
    "```js",
    "}",
    "   ",
    "for (let i = 0; i < 3; i++) { switch (i) { case 1: break; } }",
)

PY_BLOCKS = (
    "import os, sys as system\nfrom . import sibling\nfrom pkg.mod import thing as alias",
    'def classify(value, limit=100):\n    """Return a label."""\n    if value > limit and limit:\n        return "high"\n'
    '    elif value > 50:\n        return "mid"\n    else:\n        return "low"',
    "async def fetch(session, *urls, retries: int = 3):\n    async for url in urls:\n        with session.open(url) as handle:\n"
    "            assert handle\n    def inner(x):\n        for i in x:\n            while i:\n                i -= 1\n"
    "        return x\n    return inner",
    'class Shape(Base, metaclass=Meta):\n    """A shape."""\n    def area(self, /, w, *, h=2):\n        try:\n'
    "            return w * h\n        except ValueError:\n            return 0\n        finally:\n            pass\n"
    "    @property\n    def name(self):\n        'doc'\n        return [n for n in self.n if n] if self.n else None",
    'def route(code):\n    if code == 1:\n        return "a"\n    elif code == 2:\n        return "b"\n    elif code == 3:\n'
    '        return "c"\n    elif code == 4:\n        return "d"\n    elif code == 5:\n        return "e"\n    return None',
    "def long_one():\n" + "\n".join(["    step = step + 1"] * 55),
    "# comment 42\nLIMIT = 4096\nif LIMIT:\n    pass",
    "class Empty:\n    def run(self):\n        match self.kind:\n            case 12:\n                return lambda: 0\n"
    "        try:\n            pass\n        except* OSError:\n            pass",
)
