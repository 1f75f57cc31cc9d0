"""The physical plan of a DataFrame as text."""


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
