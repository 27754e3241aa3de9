"""Ledger and billing analytics expressed as Spark DataFrame operators.

Every operator takes and returns DataFrames holding *all* accounts
(``casillero``) at once; nothing is collected to the driver.
"""

__version__ = "0.1.0"
