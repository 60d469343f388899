import re

import pytest

from graphmill.llm.queries import QUERIES


@pytest.mark.parametrize("name", ["op3_url_filter", "op6_mix_weights", "op9_license_scan"])
def test_native_operators_run_no_python(spark, name):
    text = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text)
