"""Reading of plans, for tests that look at how Spark would run a query."""


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()
