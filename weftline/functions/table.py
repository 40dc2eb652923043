"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register(spark: SparkSession) -> None:
    """Makes workflow_steps(text) a table function of the session: status, job_id, position, name, uses, run of every step; one row with nulls for a file without any."""

    @udtf(returnType="status: string, job_id: string, position: int, name: string, uses: string, run: string")
    class WorkflowSteps:
        def eval(self, text: str):
            from weftline.operators.workflow import parse_document

            doc, found = parse_document(text), False
            for job in doc["jobs"] or ():
                for i, step in enumerate(job["steps"]):
                    found = True
                    yield doc["status"], job["job_id"], i + 1, step["name"], step["uses"], step["run"]
            if not found:
                yield doc["status"], None, None, None, None, None

    spark.udtf.register("workflow_steps", WorkflowSteps)
