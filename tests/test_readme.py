"""The README's usage example runs as written (on a two-file fixture)."""

import os
import re


def test_readme_usage_runs(spark, tmp_out):
    readme = open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md")).read()
    code = re.search(r"## Usage.*?```python\n(.*?)```", readme, re.S).group(1)
    exports = os.path.join(tmp_out, "*.csv")
    for part in range(2):
        with open(os.path.join(tmp_out, f"p{part}.csv"), "w") as f:
            if part == 0:
                f.write("Block;;Lab\nGroup;Age;Glucose\n;;\n")
            for i in range(part * 60, part * 60 + 60):
                g = "" if i % 7 == 0 else str(4 + (i % 9) / 10).replace(".", ",")
                f.write(f"{i % 3};{30 + i % 17};{g}\n")
    code = code.replace('"exports/*.csv"', repr(exports)).replace("spark = get_session()", "")
    scope = {"spark": spark}
    exec(compile(code, "README usage", "exec"), scope)
    assert scope["filled"].count() == 120
    assert scope["filled"].where("Glucose IS NULL").count() == 0
    assert sorted(scope["features"]) == ["Age", "Glucose"]
