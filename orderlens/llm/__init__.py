"""Training-data operators: ten corpus operators, each a function from DataFrames to a DataFrame.

Nothing outside this subpackage imports it.  Operators take any ``documents``-like
table with the columns they name (extra columns are ignored or carried, as each
docstring says) and never collect documents, pairs or components to the driver.
"""
