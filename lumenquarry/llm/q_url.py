"""op5: the urls of all pages."""

from lumenquarry.llm.url_filter import Rule, judge

NAME = "op5_url_filter"
RULES = [
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
]


def query(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


SQL = None  # the classifier isn't SQL; tests hold hosts, paths and rules against plain Python
