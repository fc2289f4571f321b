"""League statistics and data-quality jobs expressed as Spark DataFrame plans.

functions: column expressions; operators: DataFrame to DataFrame; sources and streaming: landed files; plans: whole jobs,
reports and the registered queries; llm: a separate subpackage of training-data operators that nothing here imports.
"""
