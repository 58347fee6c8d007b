"""Symbol normalisation: short or decorated call names to full names."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: short name -> full name ------------------------------------------------
SHORT_NAMES = {
    "ReadAllText": "System.IO.File.ReadAllText",
    "WriteAllText": "System.IO.File.WriteAllText",
    "ReadAllBytes": "System.IO.File.ReadAllBytes",
    "WriteAllBytes": "System.IO.File.WriteAllBytes",
    "Delete": "System.IO.File.Delete",
    "Combine": "System.IO.Path.Combine",
    "GetFullPath": "System.IO.Path.GetFullPath",
    "GetFileName": "System.IO.Path.GetFileName",
    "SqlCommand": "System.Data.SqlClient.SqlCommand",
    "SqlConnection": "System.Data.SqlClient.SqlConnection",
    "GetAsync": "System.Net.Http.HttpClient.GetAsync",
    "PostAsync": "System.Net.Http.HttpClient.PostAsync",
    "ExecuteNonQuery": "System.Data.SqlClient.SqlCommand.ExecuteNonQuery",
    "ExecuteReader": "System.Data.SqlClient.SqlCommand.ExecuteReader",
    "ExecuteScalar": "System.Data.SqlClient.SqlCommand.ExecuteScalar",
    "ExecuteSqlRaw": "Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.ExecuteSqlRaw",
    "FromSqlRaw": "Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.FromSqlRaw",
    "Start": "System.Diagnostics.Process.Start",
    "DownloadString": "System.Net.WebClient.DownloadString",
    "GetStreamAsync": "System.Net.Http.HttpClient.GetStreamAsync",
    "GetStringAsync": "System.Net.Http.HttpClient.GetStringAsync",
    "LoadXml": "System.Xml.XmlDocument.LoadXml",
    "OpenRead": "System.IO.File.OpenRead",
    "OpenWrite": "System.IO.File.OpenWrite",
    "ReadAllLines": "System.IO.File.ReadAllLines",
    "WriteAllLines": "System.IO.File.WriteAllLines",
    "AppendAllText": "System.IO.File.AppendAllText",
    "AppendAllLines": "System.IO.File.AppendAllLines",
    "CopyTo": "System.IO.Stream.CopyTo",
    "ReadLine": "System.Console.ReadLine",
    "FileName": "Microsoft.AspNetCore.Http.IFormFile.FileName",
}
REQUEST_COLLECTIONS = {
    "query": "Microsoft.AspNetCore.Http.IQueryCollection[indexer]",
    "form": "Microsoft.AspNetCore.Http.IFormCollection[indexer]",
}
HEADERS = "Microsoft.AspNetCore.Http.IHeaderDictionary[indexer]"
QUERY_STRING = "System.Web.HttpRequest.QueryString"
# ------------------------------------------------------------------------------------------


def _to_string_source(low: Column) -> Column:
    """The request collection a ToString() call reads, or NULL."""
    out = None
    for name, full in REQUEST_COLLECTIONS.items():
        hit = low.contains(f".{name}[") | low.contains(f"i{name}collection")
        out = F.when(hit, full) if out is None else out.when(hit, full)
    headers = low.contains(".headers[") | low.contains("iheaderdictionary")
    return out.when(headers, HEADERS).when(low.contains("querystring"), QUERY_STRING)


def normalize_symbol(sym: Column, text: Column, rtype: Column) -> Column:
    s = F.when(sym.startswith("global::"), F.substring(sym, 9, 1 << 20)).otherwise(sym)
    text, rtype = F.coalesce(text, F.lit("")), F.coalesce(rtype, F.lit(""))
    low, typ = F.lower(text), F.lower(rtype)
    names = F.create_map(*[F.lit(x) for x in chain(*SHORT_NAMES.items())])
    either = lambda word: low.contains(word) | typ.contains(word)
    body = low.contains("request.body") | low.contains("bodyreader")
    return (
        F.when(s.isNull() | (s == ""), s)
        .when(s == "ToString", _to_string_source(low))
        .when(s.contains("."), s)
        .when(
            (s == "SqlCommand") & low.contains("new sqlcommand"),
            F.when(either("microsoft.data.sqlclient"), "Microsoft.Data.SqlClient.SqlCommand..ctor")
            .otherwise("System.Data.SqlClient.SqlCommand..ctor"),
        )
        .when(s.isin(*SHORT_NAMES), F.try_element_at(names, s))
        .when(
            text.contains("File.") | typ.contains("system.io.file") | typ.contains("system.io.path"),
            F.concat(F.lit("System.IO.File."), s),
        )
        .when(
            text.contains("SqlCommand") | low.contains("cmd.") | typ.contains("sqlclient"),
            F.concat(F.lit("System.Data.SqlClient.SqlCommand."), s),
        )
        .when(
            text.contains("Process.") | typ.contains("system.diagnostics.process"),
            F.concat(F.lit("System.Diagnostics.Process."), s),
        )
        .when((s == "Create") & either("webrequest"), "System.Net.WebRequest.Create")
        .when((s == "Create") & either("xmlreader"), "System.Xml.XmlReader.Create")
        .when((s == "Load") & either("xmldocument"), "System.Xml.XmlDocument.Load")
        .when((s == "Load") & either("xdocument"), "System.Xml.Linq.XDocument.Load")
        .when(
            s.isin("Body", "BodyReader")
            & (body | typ.contains("httprequest.body") | typ.contains("bodyreader")),
            F.concat(F.lit("Microsoft.AspNetCore.Http.HttpRequest."), s),
        )
        .when((s == "HtmlString") & either("htmlstring"), "Microsoft.AspNetCore.Html.HtmlString..ctor")
        .otherwise(s)
    )


def with_normalized_symbol(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn(
        "resolved_symbol",
        normalize_symbol(F.col("resolved_symbol"), F.col("text"), F.col("resolved_type")),
    )
