"""Location-behaviour analytics as Spark DataFrame operators.

Layers, from small to large:

* ``functions``  - column expressions (geometry, numbers, text, parsing)
* ``sources``    - readers and writers
* ``operators``  - reusable DataFrame -> DataFrame building blocks
* ``plans``      - the five tasks: case building, features, text requests
* ``streaming``  - Structured Streaming forms of the session and popularity operators

Every operator is lazy: it takes DataFrames and returns a DataFrame.
"""
