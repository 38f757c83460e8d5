"""The domain tables as views over the generic benchmark tables.

Each block is one SELECT that means the same to Spark and to an ANSI SQL engine;
``{name}`` stands for a base table or another block.  The operators read what
these views give them and know nothing about the base tables.
"""

from __future__ import annotations

import datetime as dt
import string
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from cashtide.seeds import reference_domains
from cashtide.session import materialise

AS_OF = dt.date(1998, 6, 15)
RUN_TS = dt.datetime(1998, 6, 15, 12, 0, 0)
LEDGER_YEAR = 1998
SALT = "till-1998"

BASE_TABLES = ["customer", "nation", "orders", "lineitem", "supplier", "part", "events"]

BLOCKS = {
    "project": """
SELECT o_orderkey AS project_id, o_custkey AS customer_id,
       concat('Project ', CAST(o_orderkey AS STRING)) AS project_name,
       CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'In Progress' ELSE 'Planned' END AS status,
       CASE WHEN o_orderkey % 12 = 0 THEN CAST(2004 + o_orderkey % 1000 AS DECIMAL(12,2))
            ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS total_value,
       CAST(o_orderdate AS DATE) AS start_date,
       CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) + 90 END AS expected_completion_date
FROM {orders}""",
    "line_doc": """
SELECT ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS doc_id,
       l_orderkey, l_partkey, l_suppkey, l_linenumber,
       chr(min(ascii(l_returnflag))) AS rf, chr(min(ascii(l_linestatus))) AS ls,
       CAST(min(l_shipdate) AS DATE) AS ship_date,
       CAST(min(l_extendedprice) AS DECIMAL(12,2)) AS price,
       CAST(min(l_quantity) AS DECIMAL(12,2)) AS qty
FROM {lineitem} GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber""",
    "invoice": """
SELECT doc_id AS invoice_id, l_orderkey AS project_id,
       concat('RE-', CAST(doc_id AS STRING)) AS invoice_number,
       ship_date AS invoice_date, ship_date + 7 AS due_date, price AS amount,
       CASE WHEN rf = 'R' THEN 'Cancelled' WHEN rf = 'A' THEN 'Paid' WHEN ls = 'O' THEN 'Issued'
            WHEN l_partkey % 5 = 0 THEN 'Partially Paid' ELSE 'Overdue' END AS status
FROM {line_doc}""",
    "payment": """
SELECT invoice_id AS payment_id, invoice_id, due_date AS payment_date,
       amount, 'Bank Transfer' AS payment_method
FROM {invoice} WHERE status = 'Paid'""",
    "supplier_dim": """
SELECT s_suppkey AS supplier_id, s_name AS supplier_name,
       CAST(s_acctbal AS DECIMAL(12,2)) AS credit_limit,
       CAST(7 + s_suppkey % 24 AS INT) AS payment_terms_days
FROM {supplier}""",
    "purchase_order": """
SELECT doc_id AS order_id, l_suppkey AS supplier_id, l_orderkey AS project_id,
       ship_date AS order_date, ship_date + 14 AS expected_delivery_date,
       CAST(qty * 100 AS DECIMAL(12,2)) AS total_amount,
       CASE WHEN rf = 'R' THEN 'Cancelled' WHEN ls = 'O' THEN 'Ordered' ELSE 'Delivered' END AS status
FROM {line_doc} WHERE l_linenumber <= 2""",
    "customer_rec": """
SELECT c_custkey AS customer_id, 'Customer' AS first_name,
       concat('N', CAST(c_custkey AS STRING)) AS last_name,
       CASE WHEN c_custkey % 4 = 0 THEN concat('Haus ', CAST(c_custkey AS STRING), ' GmbH') END AS company_name,
       concat('c', CAST(c_custkey AS STRING), '@example.invalid') AS email,
       CASE WHEN c_custkey % 3 = 0 THEN concat('0', CAST(c_custkey AS STRING)) END AS phone,
       concat('Street ', CAST(c_custkey % 100 AS STRING)) AS street_name,
       CAST(1 + c_custkey % 50 AS STRING) AS house_number,
       lpad(CAST(10000 + (c_custkey * 7) % 80000 AS STRING), 5, '0') AS postal_code,
       n_name AS city, 'Germany' AS country,
       CASE WHEN c_custkey % 50 = 0 THEN CAST('1998-01-01 00:00:00' AS TIMESTAMP) END AS pseudonymized_at
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey""",
    "cost": """
SELECT event_id AS cost_id, CAST(value AS DECIMAL(12,2)) AS amount,
       DATE '1998-05-01' + CAST(event_id % 120 AS INT) AS cost_date,
       CASE WHEN event_type IN ('error', 'signup') THEN 'Operational Overhead' ELSE 'Direct Project' END AS cost_category
FROM {events}""",
    "operational_cost": """
SELECT cost_id,
       CASE cost_id % 5 WHEN 0 THEN 'Rent' WHEN 1 THEN 'Fuel' WHEN 2 THEN 'Advertising'
                        WHEN 3 THEN 'Insurance' ELSE 'Software License' END AS overhead_category,
       cost_category
FROM {cost} WHERE cost_id % 101 <> 0 AND (cost_category = 'Operational Overhead' OR cost_id % 97 = 0)""",
    "project_cost": """
SELECT cost_id, CASE WHEN cost_id % 89 = 0 THEN cost_id + 100000000 ELSE cost_id END AS project_id,
       CASE cost_id % 2 WHEN 0 THEN 'Materials' ELSE 'Labor' END AS direct_cost_type,
       cost_category
FROM {cost} WHERE cost_id % 101 <> 0 AND (cost_category = 'Direct Project' OR cost_id % 97 = 0)""",
    "product": """
SELECT p_partkey AS product_id, p_name AS product_name,
       CASE p_partkey % 6 WHEN 0 THEN 'Module' WHEN 1 THEN 'Inverter' WHEN 2 THEN 'Mounting'
                          WHEN 3 THEN 'Battery' WHEN 4 THEN 'Cabling' ELSE 'Other' END AS category,
       CAST(p_retailprice AS DECIMAL(12,2)) AS unit_cost
FROM {part}""",
    "project_product": """
SELECT l_orderkey AS project_id, l_partkey AS product_id,
       CAST(sum(l_quantity) AS INT) AS quantity,
       CAST(min(l_extendedprice) AS DECIMAL(12,2)) AS unit_price_charged
FROM {lineitem} GROUP BY l_orderkey, l_partkey""",
    "staging": """
SELECT CAST(1 AS BIGINT) AS run_id, CAST(o_orderkey + 2 AS INT) AS row_number,
       CASE o_orderkey % 20 WHEN 1 THEN '' ELSE concat('IN-', CAST(o_orderkey AS STRING)) END AS raw_invoice_number,
       CASE o_orderkey % 20 WHEN 2 THEN 'P7' WHEN 3 THEN '99999999' WHEN 13 THEN '123456789012345678901'
            ELSE CAST(o_orderkey AS STRING) END AS raw_project_id,
       CASE o_orderkey % 20 WHEN 4 THEN '21-09-1998' WHEN 14 THEN '1998-02-30'
            ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS raw_invoice_date,
       CASE o_orderkey % 20 WHEN 5 THEN 'soon' WHEN 6 THEN '1990-01-01'
            ELSE CAST(CAST(o_orderdate AS DATE) + 7 AS STRING) END AS raw_due_date,
       CASE o_orderkey % 20 WHEN 7 THEN '-500.00' WHEN 8 THEN '12.345' WHEN 15 THEN '12345678901.00'
            ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) END AS raw_amount,
       CASE o_orderkey % 20 WHEN 9 THEN 'Draft' WHEN 10 THEN 'Paid' ELSE 'Issued' END AS raw_status
FROM {orders}""",
    # Half of the batch updates invoices that exist: those of line 1 documents.
    "rerun_staging": """
SELECT run_id, row_number,
       CASE WHEN row_number % 2 = 0 OR known.invoice_number IS NULL THEN raw_invoice_number
            ELSE known.invoice_number END AS raw_invoice_number,
       raw_project_id, raw_invoice_date, raw_due_date, raw_amount, raw_status
FROM {staging} LEFT JOIN (SELECT project_id, min(invoice_number) AS invoice_number FROM {invoice} GROUP BY project_id) AS known
  ON CAST(row_number - 2 AS BIGINT) = known.project_id""",
    # A payment names the first revenue document of its order, where there is one.
    "first_doc": """
SELECT l_orderkey AS first_order, min(doc_id) AS first_doc
FROM {line_doc} WHERE l_linenumber <= 2 GROUP BY l_orderkey""",
    "ledger": """
SELECT doc_id AS line,
       CASE l_linenumber WHEN 1 THEN '4400' WHEN 2 THEN '4400' WHEN 3 THEN '1800' WHEN 4 THEN '5400'
                         WHEN 5 THEN '6805' WHEN 6 THEN '1800' ELSE '1200' END AS konto,
       CASE WHEN l_linenumber <= 3 THEN CAST(10000 + l_suppkey % 50 AS STRING)
            ELSE CAST(70000 + l_suppkey AS STRING) END AS gegenkonto,
       CASE WHEN rf = 'R' THEN 'S' ELSE 'H' END AS soll_haben,
       CASE WHEN l_partkey % 997 = 0 THEN 'n/a'
            WHEN l_partkey % 20 >= 9 THEN concat('1.', lpad(CAST((l_partkey % 20 - 9) * 50 AS STRING), 3, '0'), ',50')
            ELSE concat(CAST((l_partkey % 20 + 1) * 100 AS STRING), ',50') END AS umsatz,
       CASE WHEN l_partkey % 499 = 0 THEN '3002' WHEN l_partkey % 3 = 0 THEN '105'
            WHEN l_partkey % 3 = 1 THEN '3112' ELSE '1506' END AS belegdatum,
       CASE WHEN l_linenumber = 3 THEN CAST(coalesce(first_doc, doc_id - 2) AS STRING) ELSE CAST(doc_id AS STRING) END AS belegfeld1,
       concat('Posting ', CAST(l_partkey AS STRING)) AS buchungstext,
       CASE WHEN l_partkey % 4 = 0 THEN ''
            WHEN l_partkey % 7 = 0 THEN concat('Party ', CAST(l_suppkey AS STRING), ' GmbH')
            ELSE concat('Party ', CAST(l_suppkey AS STRING)) END AS name
FROM {line_doc} LEFT JOIN {first_doc} ON first_order = l_orderkey""",
    # --- state left by earlier runs, for the operators that change a table --
    "schedule_before": """
SELECT -(project_id * 10 + 1) AS schedule_id, project_id, 'STAGE_1_ROOF' AS milestone_code,
       CAST(20 AS INT) AS due_offset_days, CAST(1.00 AS DECIMAL(12,2)) AS expected_amount,
       CASE WHEN project_id % 2 = 0 THEN 'Overdue' ELSE 'Pending' END AS status, 'seed' AS created_by
FROM {project} WHERE project_id % 3 = 0
UNION ALL
SELECT -(project_id * 10 + 2), project_id, 'SINGLE_PAYMENT', CAST(0 AS INT), CAST(2.50 AS DECIMAL(12,2)), 'Pending', 'seed'
FROM {project} WHERE project_id % 7 = 0""",
    "forecast_before": """
SELECT project_id, start_date AS forecast_date, total_value AS expected_cash_in,
       CAST(0 AS DECIMAL(12,2)) AS expected_cash_out, total_value AS net_cashflow,
       'customer_milestone' AS flow_source, 'seed' AS created_by
FROM {project}""",
    "fact_before": """
SELECT CAST(year(start_date) * 10000 + month(start_date) * 100 + day(start_date) AS INT) AS date_key,
       project_id AS project_key, customer_id AS customer_key, CAST(NULL AS BIGINT) AS cost_type_key,
       total_value AS expected_cash_in, CAST(0 AS DECIMAL(12,2)) AS expected_cash_out, total_value AS net_cashflow
FROM {project}""",
    "days_before": """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS full_date FROM {orders}""",
    "dim_project_before": """
SELECT project_id AS project_key, project_id, 'Old name' AS project_name, 'Planned' AS status,
       CAST(0 AS DECIMAL(12,2)) AS total_value
FROM {project} WHERE project_id % 2 = 0
UNION ALL
SELECT -project_id, -project_id, 'Gone', 'Completed', CAST(1 AS DECIMAL(12,2))
FROM {project} WHERE project_id % 100 = 1""",
    "dim_customer_before": """
SELECT customer_id AS customer_key, customer_id, 'Old name' AS customer_name, 'Nowhere' AS city, '00000' AS postal_code
FROM {customer_rec} WHERE customer_id % 2 = 0""",
    "cost_types_before": """
SELECT DISTINCT 'Operational Overhead' AS cost_category, overhead_category AS cost_subcategory, false AS is_indirect
FROM {operational_cost} WHERE overhead_category IN ('Rent', 'Fuel')""",
    # Some customers have settled everything and may be erased.
    "settled_invoice": """
SELECT i.invoice_id, i.project_id, i.invoice_number, i.invoice_date, i.due_date, i.amount,
       CASE WHEN p.customer_id % 15 = 0 THEN 'Paid' ELSE i.status END AS status
FROM {invoice} AS i LEFT JOIN {project} AS p ON p.project_id = i.project_id""",
    "erasure_request": """
SELECT customer_id FROM {customer_rec} WHERE customer_id % 5 = 0
UNION ALL
SELECT customer_id + 1000000000 FROM {customer_rec} WHERE customer_id % 100 = 1""",
    "posting_key": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem}""",
}


# Tables of the model and the blocks they come from.
DOMAIN_TABLES = {
    "project": "project",
    "customer": "customer_rec",
    "invoice": "invoice",
    "payment": "payment",
    "supplier": "supplier_dim",
    "purchase_order": "purchase_order",
    "cost": "cost",
    "project_cost": "project_cost",
    "operational_cost": "operational_cost",
}


# Blocks that queries with many readers group once, store and read back.
STORED = ("line_doc",)

# The order in which a stored block is laid out, and the table whose rows are cut by it, so that rows
# of an order are in one file or two: readers that group by it send little, however many rows it has.
LAID_OUT = {"line_doc": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])}


def placeholders(sql: str) -> list[str]:
    """The tables a block reads, each once, in the order of first use."""
    return list(dict.fromkeys(name for _, name, _, _ in string.Formatter().parse(sql) if name))


class Derived:
    """Base and derived tables of one data directory, built on first use; the ``stored`` ones
    are written to the scratch folder then."""

    def __init__(self, spark: SparkSession, directory: str, stored: Sequence[str] = ()):
        self.spark = spark
        self.directory = directory.rstrip("/")
        self.stored = stored
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in BASE_TABLES:
                self._frames[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
            else:
                text = BLOCKS[name]
                read = {n: self[n] for n in placeholders(text)}
                if name in self.stored:
                    table, order = LAID_OUT[name]
                    read[table] = read[table].repartitionByRange(*order)
                    self._frames[name] = materialise(self.spark.sql(text, **read).sortWithinPartitions(*order))
                else:
                    self._frames[name] = self.spark.sql(text, **read)
        return self._frames[name]

    def tables(self, *names: str) -> dict[str, DataFrame]:
        """The named tables of the model, or all that can be derived."""
        domains = [n for n in names if n not in DOMAIN_TABLES] if names else None
        rows = {} if domains == [] else reference_domains(self.spark, domains)
        return {**rows, **{n: self[DOMAIN_TABLES[n]] for n in names or DOMAIN_TABLES if n in DOMAIN_TABLES}}
