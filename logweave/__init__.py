"""logweave: Spark-native operators for web-log ETL, log reconciliation,
stream token counts and the table work around them.

Every operator takes and returns DataFrames (or Columns) built from native
Spark expressions, so Catalyst can push filters, prune columns and keep the
work inside whole-stage codegen.
"""

from logweave.session import get_session, shared_dir, table

__all__ = ["get_session", "shared_dir", "table"]
