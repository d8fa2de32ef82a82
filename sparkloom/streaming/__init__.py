"""The order-free operators on unbounded tables: reductions, dictionaries and duplicate removal."""
