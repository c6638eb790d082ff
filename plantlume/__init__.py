"""Operations intelligence for energy-intensive plants, written as Spark plans.

``sources``    typed scans and sinks
``functions``  column expressions (scores, shifts, finance)
``operators``  table operators with column-name parameters
``plans``      marts, features, scores, scenarios, portfolios, governance, serving
``workload``   the same plans bound to the driver's tables, with their SQL checks
"""
