"""Property tests: distributed running totals == brute-force prefix sums."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from keelson.operators.ordered import running_totals

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-50, 50), st.integers(-3, 5)),
    min_size=1, max_size=60, unique_by=lambda t: (t[0], t[1]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows_strategy, buckets=st.sampled_from([2, 3, 8, 32]), grouped=st.booleans())
def test_running_totals_property(spark, data, buckets, grouped):
    df = spark.createDataFrame(data, "g string, v int, w int")
    if grouped:
        out = running_totals(df, ["v"], ["w"], ["g"], buckets=buckets)
        want = {(g, v): sum(w2 for g2, v2, w2 in data if g2 == g and v2 <= v) for g, v, _ in data}
    else:
        out = running_totals(df, ["v", "g"], ["w"], buckets=buckets)  # (v, g) is a total order
        want = {(g, v): sum(w2 for g2, v2, w2 in data if (v2, g2) <= (v, g)) for g, v, _ in data}
    got = {(r["g"], r["v"]): r["cum_w"] for r in out.collect()}
    assert got == want
