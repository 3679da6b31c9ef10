"""A4: the built-in product catalog (``GetCatalog``)."""

from pyspark.sql import DataFrame, SparkSession

from skyledger.schemas import PRODUCT

# Fixed values that must equal the reference: the ten catalog products
# (id, name, description, category, unit price).
BUILTIN_PRODUCTS = [
    ("1", "Snow Crash", "book by Neal Stephenson", "book", 13.13),
    ("2", "Blindsight", "book by Peter Watts", "book", 10.43),
    ("3", "Artemis", "book by Andy Weir", "book", 12.78),
    ("4", "Super Wings - Transforming Astra Toy Figure", 'Spaceshipt Bot, 5" scale', "toy", 19.99),
    ("5", "Super Wings - Transforming Agent Chase Toy Figure", 'Spaceshipt Bot, 5" scale', "toy", 19.99),
    ("6", "Octopath Traveller", "Choose your fate.  Eight stories await", "video game", 59.99),
    ("7", "WOMAGE Faux Leather Men Quartz Write Watch", "Oversized Red", "watch", 6.83),
    ("8", "Loweryeah Metal Strap Female Watch", "Rhine stone strap", "watch", 5.40),
    ("9", "Samsung 960 EVO Series - 500GB NVMe - M.2", "High speed solid state memory", "memory", 168.95),
    ("10", "Intel Core i7-8700K Desktop Processor", "6 Cores up to 5.7GHz", "cpu", 347.00),
]


def builtin_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUILTIN_PRODUCTS, PRODUCT)


def list_catalog(catalog: DataFrame) -> DataFrame:
    """``GetCatalog``: every product, in id order of the source."""
    return catalog.select("id", "name", "description", "category", "unit_price")
