"""Column sets of the ready-made wide tables.

The operators take a ``TableSpec`` and know no column names; these presets describe the two tables
the packaged workflows expect.
"""

from __future__ import annotations

from pyspark.sql import types as T

from widecast.spec import TableSpec

KEY = "user"
LABEL = "label"

# Column names of the conformed table, by type.
INT_COLUMNS = """
credit_level membership_level gender inet_pd_inst_cnt star_level last_year_capture_user_flag app_cnt
dt_m_1000 dt_m_1003 dt_m_1005 dt_m_1006 dt_m_1009 dt_m_1011 dt_m_1012 dt_m_1015 dt_m_1017 dt_m_1027
dt_m_1028 dt_m_1041 dt_m_1044 dt_m_1051 dt_m_1053 dt_m_1067 dt_m_1069 dt_m_1073 dt_m_1074 dt_m_1075
dt_m_1096 dt_m_1099 dt_m_1102 dt_m_1105 dt_m_1108 dt_m_1111 dt_m_1594 dt_m_1601 dt_m_1617 dt_m_1630
dt_m_1633
app1_visits app2_visits app3_visits app4_visits app5_visits app6_visits app7_visits app8_visits
""".split()
LONG_COLUMNS = ["dt_m_1618"]
DOUBLE_COLUMNS = """
dt_m_1004 dt_m_1032 dt_m_1034 dt_m_1035 dt_m_1085 dt_m_1086 dt_m_1087 dt_m_1620
access_net_dur prdOpen_dur prdOpen_net_dur tmlRegister_dur tmlRegister_net_dur
age_level cust_point_level market_price_level
""".split()
STRING_COLUMNS = ["brand", "product"]

# What the preparation consumes and makes.
VISIT_COLUMNS = [f"app{i}_visits" for i in range(1, 9)]
POINT_COLUMN = ("cust_point", "cust_point_level")
RAW_ONLY_COLUMNS = ["age", "market_price", "cust_point"]
DIFFERENCES = {  # new column: (minuend, which is then dropped, subtrahend)
    "dt_m_1044": ("dt_m_1043", "dt_m_1041"),
    "dt_m_1053": ("dt_m_1052", "dt_m_1051"),
    "dt_m_1069": ("dt_m_1068", "dt_m_1067"),
}
PRODUCTS = {  # new column: the two factors; the first is then left out of the predictors
    "dt_m_1085_v": ("dt_m_1085", "dt_m_1006"),
    "dt_m_1086_v": ("dt_m_1086", "dt_m_1006"),
    "dt_m_1087_v": ("dt_m_1087", "dt_m_1006"),
}
PICKLIST_COLUMNS = ["credit_level", "gender", "age_level", "market_price_level", "cust_point_level", "brand", "product"]

# The predictors of the model table.
MODEL_COLUMNS = """
credit_level gender inet_pd_inst_cnt star_level
dt_m_1000 dt_m_1003 dt_m_1004 dt_m_1005 dt_m_1006 dt_m_1009 dt_m_1011 dt_m_1012 dt_m_1015 dt_m_1017
dt_m_1027 dt_m_1028 dt_m_1041 dt_m_1044 dt_m_1051 dt_m_1053 dt_m_1067
dt_m_1069 dt_m_1073 dt_m_1074 dt_m_1075 dt_m_1085 dt_m_1086 dt_m_1087 dt_m_1096 dt_m_1099 dt_m_1102
dt_m_1105 dt_m_1108 dt_m_1111 dt_m_1594 dt_m_1601 dt_m_1617 dt_m_1618 dt_m_1620 dt_m_1630 dt_m_1633
last_year_capture_user_flag app1_visits app2_visits app3_visits app4_visits app5_visits app6_visits
app7_visits app8_visits access_net_dur tmlRegister_net_dur prdOpen_dur tmlRegister_dur prdOpen_net_dur
brand product cust_point_level age market_price_level app_cnt dt_m_1012_type
dt_m_1027_type dt_m_1032_type dt_m_1034_type dt_m_1075_type dt_m_1086_type dt_m_1087_type
dt_m_1096_type dt_m_1102_type dt_m_1108_type dt_m_1594_type dt_m_1617_type dt_m_1620_type
dt_m_1630_type dt_m_1633_type app1_visits_type app2_visits_type app3_visits_type
app4_visits_type app5_visits_type app6_visits_type app7_visits_type app8_visits_type
dt_m_1087_pref in_10s_per in_10_30s_per in_30_60s_per out_60s_per dt_m_1035_pref
""".split()

# Model-table columns read as categories whatever their type.
CATEGORY_COLUMNS = """
gender star_level last_year_capture_user_flag
market_price_level cust_point_level credit_level dt_m_1012_type
dt_m_1027_type dt_m_1032_type dt_m_1034_type dt_m_1075_type dt_m_1086_type dt_m_1087_type
dt_m_1096_type dt_m_1102_type dt_m_1108_type dt_m_1594_type dt_m_1617_type dt_m_1620_type
dt_m_1630_type dt_m_1633_type app1_visits_type app2_visits_type app3_visits_type dt_m_1035_pref
app4_visits_type app5_visits_type app6_visits_type app7_visits_type app8_visits_type dt_m_1087_pref
""".split()

# Class-balancing factors, folds, seeds and search budget of the packaged workflows.
CLASS_FACTORS = [1.0, 1.0, 0.2, 1.0, 1.0]
MAX_BALANCED_SIZE = 2.0
FOLDS = 5
FOLD_SEED = 67829
HOLDOUT_SHARE = 0.2
HOLDOUT_SEED = 42
SPLIT_SHARES = [0.8, 0.2]
MAX_MODELS = 12
MAX_RUNTIME_SECS = 14400


# Settings of the packaged models that results must agree with.
GRADIENT_SETTINGS = {"rounds": 120, "depth": 8, "column_rate": 0.2, "row_rate": 0.7, "annealing": 1.0}
NEWTON_SETTINGS = {"rounds": 120, "depth": 10, "column_rate": 0.3, "row_rate": 0.7, "eta": 0.1}
FOREST_SETTINGS = {"trees": 200, "depth": 15, "column_rate": "0.3"}
BAYES_SETTINGS = {"laplace": 0.1}
BALANCED_GRADIENT_CHANGES = {"depth": 7}
BALANCED_NEWTON_CHANGES = {"rounds": 150, "depth": 7}
STACK_SETTINGS = {"rounds": 50, "depth": 4, "annealing": 0.99}

# Grids of the typed selection.
LOGISTIC_GRID = {"regularization": [0.05, 0.1], "elastic_net": [0.01], "max_iter": [50, 100, 80]}
FOREST_GRID = {"depth": [7, 10, 8], "min_rows": [30, 50, 40], "seed": [42], "trees": [100, 300, 200]}
VECTOR_BAYES_GRID = {"smoothing": [1.0]}
BOOST_GRID = {"rounds": [100], "eta": [0.1, 0.3], "depth": [7, 10, 8], "min_child_weight": [1.0, 5.0, 10.0]}

# Classes kept by the typed selection, levels kept by the pivot of its pick lists.
MAX_LABELS = 100
PIVOT_TOP_K = 20
PIVOT_MIN_SUPPORT = 10


def conformed_schema() -> T.StructType:
    """Schema of the prepared table; only the key is required."""
    fields = [T.StructField(KEY, T.StringType(), False)]
    for names, data_type in (
        (INT_COLUMNS, T.IntegerType()),
        (LONG_COLUMNS, T.LongType()),
        (DOUBLE_COLUMNS, T.DoubleType()),
        (STRING_COLUMNS, T.StringType()),
    ):
        fields += [T.StructField(n, data_type, True) for n in names]
    fields.append(T.StructField(LABEL, T.StringType(), True))
    return T.StructType(fields)


def model_columns() -> list[str]:
    """The predictors of the model table."""
    return list(MODEL_COLUMNS)


def typed_spec() -> TableSpec:
    """Roles and kinds of the conformed table once the product columns are added."""
    replaced = {factors[0] for factors in PRODUCTS.values()}
    chosen = set(PICKLIST_COLUMNS)
    real = [c for c in DOUBLE_COLUMNS + LONG_COLUMNS if c not in replaced | chosen]
    integral = [c for c in INT_COLUMNS if c not in chosen and c != "membership_level"]
    return TableSpec.build(
        KEY,
        LABEL,
        real=[*real, *PRODUCTS],
        integral=integral,
        picklist=PICKLIST_COLUMNS,
        ignored=["membership_level", *sorted(replaced)],
    )
