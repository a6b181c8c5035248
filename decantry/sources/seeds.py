"""Hand fixtures from the reference's seed data (used by tests and examples).

Registered queries never run on these alone; they read the driver tables.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

# Fixed values that must equal the reference's: the 23-product catalogue seed
# (name, brand, price 2 ml, 3 ml, 5 ml, 10 ml), in the reference's order.
CATALOG_SEED = [
    ("Le Sel d'Issey", "Issey Miyake", "3.33", "4.23", "6.1", "10.69"),
    ("Amber Oud Gold Edition", "Al Haramain", "2.89", "3.56", "4.99", "8.46"),
    ("Dior Homme Intense", "Dior", "4.14", "5.45", "8.13", "14.75"),
    ("Mercedes-Benz Club Black", "Mercedes-Benz", "3.36", "4.27", "6.16", "10.81"),
    ("CK One", "Calvin Klein", "1.92", "2.1", "2.56", "3.6"),
    ("La Nuit de L'Homme", "Yves Saint Laurent", "2.51", "2.99", "4.03", "6.55"),
    ("Club de Nuit Sillage", "Armaf", "2.62", "3.16", "4.32", "7.13"),
    ("Détour Noir", "Al Haramain", "2.19", "2.52", "3.25", "4.99"),
    ("Fico di Amalfi", "Acqua di Parma", "3.85", "5.0", "7.38", "13.25"),
    ("Eros", "Versace", "2.63", "3.18", "4.35", "7.19"),
    ("Bois Impérial", "Essential Parfums", "3.06", "3.82", "5.41", "9.32"),
    ("Bal d'Afrique", "Byredo", "8.54", "12.03", "19.11", "36.7"),
    ("Le Rem", "Réminiscence", "3.53", "4.53", "6.6", "11.69"),
    ("Le Beau", "Jean Paul Gaultier", "3.14", "3.93", "5.61", "9.7"),
    ("Stronger With You", "Giorgio Armani", "3.3", "4.18", "6.01", "10.51"),
    ("Torino 21", "Xerjoff", "6.88", "9.55", "14.96", "28.41"),
    ("First Instinct", "Abercrombie & Fitch", "2.53", "3.03", "4.1", "6.69"),
    ("Egeo Bomb Black", "O Boticário", "2.87", "3.53", "4.93", "8.36"),
    ("Armani Code", "Giorgio Armani", "2.49", "2.96", "3.99", "6.46"),
    ("Starwalker", "Montblanc", "2.64", "3.19", "4.37", "7.22"),
    ("Nautica Voyage", "Nautica", "2.05", "2.3", "2.88", "4.26"),
    ("Cool Water", "Davidoff", "1.93", "2.13", "2.6", "3.7"),
    ("Sauvage", "Dior", "2.25", "2.61", "3.39", "5.27"),
]

# Fixed values that must equal the reference's: reward settings seed thresholds
# (id, threshold in bookmarks, active, sort_order). Labels are not needed by any rule.
REWARD_SEED = [
    ("reward-30", 30, True, 10),
    ("reward-75", 75, True, 20),
    ("reward-150", 150, True, 30),
    ("reward-250", 250, True, 40),
]


def catalog_seed(spark: SparkSession) -> DataFrame:
    rows = [(n, b, *[Decimal(p) for p in ps], True) for n, b, *ps in CATALOG_SEED]
    return spark.createDataFrame(rows, "name string, brand string, price_2ml decimal(10,2), price_3ml decimal(10,2), "
                                       "price_5ml decimal(10,2), price_10ml decimal(10,2), active boolean")


def reward_seed(spark: SparkSession) -> DataFrame:
    rows = [(i, t, i, a, o) for i, t, a, o in REWARD_SEED]
    return spark.createDataFrame(rows, "id string, threshold int, reward_label string, active boolean, sort_order int")
