"""JDBC URLs for the databases that can be read."""

from __future__ import annotations

from urllib.parse import quote

#: Driver class and usual port of each dialect (fixed values).
DIALECTS = {
    "snowflake": ("net.snowflake.client.jdbc.SnowflakeDriver", 443),
    "sqlserver": ("com.microsoft.sqlserver.jdbc.SQLServerDriver", 1433),
    "oracle": ("oracle.jdbc.OracleDriver", 1521),
    "postgresql": ("org.postgresql.Driver", 5432),
    "sqlite": (None, None),
    "derby": ("org.apache.derby.iapi.jdbc.AutoloadedDriver", None),
}


def connection_url(dialect: str, host: str = "", database: str = "", port: int | str | None = None, warehouse: str | None = None, schema: str | None = None, encrypt: bool = True) -> str:
    """A JDBC URL without credentials: user and password go as properties, where no character needs escaping."""
    kind = dialect.lower().replace(" ", "").replace("postgres", "postgresql").replace("postgresqlql", "postgresql")
    if kind not in DIALECTS:
        raise ValueError(f"Unsupported dialect: {dialect}")
    port = port or DIALECTS[kind][1]
    if kind == "sqlite":
        return f"sqlite:///{database}"
    if kind == "derby":
        return f"jdbc:derby:{database}"
    if kind == "snowflake":
        options = {"db": database, "warehouse": warehouse, "schema": schema}
        given = "&".join(f"{k}={quote(str(v), safe='')}" for k, v in options.items() if v)
        return f"jdbc:snowflake://{host if '.' in host else host + '.snowflakecomputing.com'}/" + (f"?{given}" if given else "")
    if kind == "sqlserver":
        return f"jdbc:sqlserver://{host}:{port};databaseName={{{database.replace('}', '}}')}}};encrypt={str(encrypt).lower()}"
    if kind == "oracle":
        return f"jdbc:oracle:thin:@//{host}:{port}/{database}"
    return f"jdbc:postgresql://{host}:{port}/{quote(database, safe='')}"


def driver_of(url: str) -> str | None:
    """The driver class for a JDBC URL."""
    return next((d for k, (d, _) in DIALECTS.items() if url.startswith(f"jdbc:{k}:")), None)
