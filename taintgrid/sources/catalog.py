"""The built-in rule catalogue, as a table built by rule: a type and its members per line.

Ids count up inside a family (`SSRF-001`, `SSRF-002`, …). Texts (name, description, remediation,
tags) are derived from the symbol and the kind. User rules are added as tables, see `rules.py`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RULE_SCHEMA = (
    "ordinal int, id string, rule_type string, symbol string, name string, vulnerability string, "
    "tainted_args array<int>, always_vulnerable boolean, confidence_level string, severity string, "
    "cwe string, cvss_base double, safe_alternative string, taint_label string, "
    "severity_multiplier double, implicit boolean, data_format string, authentication_context string, "
    "sanitizes array<string>, sanitizer_type string, encoding_context array<string>, "
    "confidence_score double, limitations string, description string, remediation string, "
    "frameworks array<string>, tags array<string>, is_custom boolean"
)

# --- fixed values -------------------------------------------------------------------------
# Sinks. `family kind cwe`, then lines `Type: members | arguments | confidence SEVERITY score | frameworks`.
SINKS = """
= SQL-ADO SQL_INJECTION CWE-89
System.Data.SqlClient.SqlCommand: .ctor | 0 | high CRITICAL 9.8 | generic aspnetcore aspnet_mvc wcf
System.Data.SqlClient.SqlCommand: CommandText | 0 | high CRITICAL 9.8 | generic aspnetcore aspnet_mvc
System.Data.SqlClient.SqlDataAdapter: .ctor | 0 | high CRITICAL 9.8 | generic aspnetcore aspnet_mvc
= SQL-OLEDB SQL_INJECTION CWE-89
System.Data.OleDb.OleDbCommand: .ctor | 0 | high CRITICAL 9.8 | generic aspnetcore aspnet_mvc
= SQL-ODBC SQL_INJECTION CWE-89
System.Data.Odbc.OdbcCommand: .ctor | 0 | high CRITICAL 9.8 | generic
= SQL-MSDATA SQL_INJECTION CWE-89
Microsoft.Data.SqlClient.SqlCommand: .ctor CommandText | 0 | high CRITICAL 9.8 | generic aspnetcore
= SQL-EF SQL_INJECTION CWE-89
Microsoft.EntityFrameworkCore.RelationalQueryableExtensions: FromSqlRaw ExecuteSqlRaw | 1 | high CRITICAL 9.8 | ef_core aspnetcore
Microsoft.EntityFrameworkCore.RelationalDatabaseFacadeExtensions: ExecuteSqlRaw | 1 | high CRITICAL 9.8 | ef_core
Microsoft.EntityFrameworkCore.RelationalQueryableExtensions: FromSqlInterpolated | 1 | medium HIGH 8.1 | ef_core
= SQL-EF6 SQL_INJECTION CWE-89
System.Data.Entity.Database: ExecuteSqlCommand | 0 | high CRITICAL 9.8 | ef6
System.Data.Entity.Database: SqlQuery | 1 | high CRITICAL 9.8 | ef6
System.Data.Entity.DbSet: SqlQuery | 0 | high CRITICAL 9.8 | ef6
= SQL-DAPPER SQL_INJECTION CWE-89
Dapper.SqlMapper: Execute Query | 1 | high CRITICAL 9.8 | dapper aspnetcore generic
Dapper.SqlMapper: QueryAsync ExecuteAsync QueryFirstOrDefault QueryFirstOrDefaultAsync | 1 | high CRITICAL 9.8 | dapper aspnetcore
Dapper.SqlMapper: QuerySingle QueryMultiple | 1 | high CRITICAL 9.8 | dapper
= SQL-NPOCO SQL_INJECTION CWE-89
NPoco.Database: Execute Fetch | 0 | high HIGH 9.0 | generic
= SQL-NHIBERNATE SQL_INJECTION CWE-89
NHibernate.ISession: CreateSQLQuery CreateNativeQuery | 0 | high CRITICAL 9.8 | generic
= SQL-ORMLITE SQL_INJECTION CWE-89
ServiceStack.OrmLite.OrmLiteReadExpressionsApi: SqlList | 1 | high HIGH 9.0 | generic
ServiceStack.OrmLite.OrmLiteWriteCommandExtensions: ExecuteSql | 1 | high HIGH 9.0 | generic
= SQL-PATTERN SQL_INJECTION CWE-89
__interpolated_string_sql | 0 | high CRITICAL 9.8 | generic aspnetcore ef_core
__string_concat_sql | 0 | high CRITICAL 9.8 | generic
= CMD COMMAND_INJECTION CWE-78
System.Diagnostics.Process: Start | 0 1 | high CRITICAL 9.8 | generic aspnetcore aspnet_mvc
System.Diagnostics.ProcessStartInfo: .ctor | 0 | high CRITICAL 9.8 | generic aspnetcore
System.Diagnostics.ProcessStartInfo: FileName | 0 | high CRITICAL 9.8 | generic
System.Diagnostics.ProcessStartInfo: Arguments | 0 | medium HIGH 8.8 | generic
System.Diagnostics.ProcessStartInfo: UseShellExecute | 0 | medium HIGH 8.1 | generic
Renci.SshNet.SshClient: RunCommand CreateCommand | 0 | high CRITICAL 9.8 | generic
System.Management.Automation.PowerShell: AddScript | 0 | high CRITICAL 9.8 | generic
System.Management.Automation.PowerShell: AddCommand | 0 | medium HIGH 8.1 | generic
System.Management.ManagementObjectSearcher: .ctor | 0 | medium HIGH 7.5 | generic
= XXE XXE CWE-611
System.Xml.XmlDocument: Load | 0 | high HIGH 7.5 | generic aspnetcore wcf
System.Xml.XmlDocument: LoadXml | 0 | high HIGH 7.5 | generic aspnetcore
System.Xml.XmlTextReader: .ctor | 0 | high HIGH 7.5 | generic
System.Xml.XmlReader: Create | 0 | medium HIGH 7.5 | generic aspnetcore
System.Xml.Linq.XDocument: Load | 0 | medium MEDIUM 5.9 | generic
System.Xml.Linq.XElement: Load | 0 | medium MEDIUM 5.9 | generic
System.Xml.Linq.XDocument: Parse | 0 | medium MEDIUM 5.9 | generic
System.Xml.Serialization.XmlSerializer: Deserialize | 0 | medium MEDIUM 5.9 | generic wcf
System.Xml.XPath.XPathDocument: .ctor | 0 | medium HIGH 6.5 | generic
System.Xml.Schema.XmlSchema: Read | 0 | low MEDIUM 5.3 | generic
= DESER INSECURE_DESERIALIZATION CWE-502
System.Runtime.Serialization.Formatters.Binary.BinaryFormatter: Deserialize | 0 | always confirmed CRITICAL 9.8 | generic aspnetcore aspnet_mvc
System.Runtime.Serialization.Formatters.Binary.BinaryFormatter: UnsafeDeserialize | 0 | always confirmed CRITICAL 9.8 | generic
System.Runtime.Serialization.Formatters.Soap.SoapFormatter: Deserialize | 0 | always confirmed CRITICAL 9.8 | generic wcf
System.Runtime.Serialization.NetDataContractSerializer: Deserialize | 0 | always high CRITICAL 9.8 | generic wcf
System.Web.UI.LosFormatter: Deserialize | 0 | high CRITICAL 9.8 | aspnet_mvc
System.Web.Script.Serialization.JavaScriptSerializer: Deserialize | 0 | high CRITICAL 9.8 | aspnet_mvc
System.Web.Script.Serialization.JavaScriptSerializer: DeserializeObject | 0 | high HIGH 8.1 | aspnet_mvc
Newtonsoft.Json.JsonConvert: DeserializeObject | 0 | medium HIGH 8.1 | generic aspnetcore
Newtonsoft.Json.JsonSerializer: Deserialize | 0 | medium HIGH 8.1 | generic
System.Runtime.Serialization.DataContractSerializer: ReadObject | 0 | medium MEDIUM 6.5 | wcf generic
YamlDotNet.Serialization.Deserializer: Deserialize | 0 | high HIGH 8.1 | generic
YamlDotNet.Serialization.DeserializerBuilder: Build | 0 | low MEDIUM 5.9 | generic
MessagePack.MessagePackSerializer: Deserialize | 0 | medium HIGH 8.1 | generic
System.Web.UI.ObjectStateFormatter: Deserialize | 0 | high CRITICAL 9.8 | aspnet_mvc
= SSRF SSRF CWE-918
System.Net.Http.HttpClient: GetAsync | 0 | high HIGH 8.6 | generic aspnetcore aspnet_mvc
System.Net.Http.HttpClient: PostAsync PutAsync DeleteAsync SendAsync GetStringAsync GetByteArrayAsync GetStreamAsync | 0 | high HIGH 8.6 | generic aspnetcore
System.Net.WebClient: DownloadString | 0 | high HIGH 8.6 | generic aspnet_mvc
System.Net.WebClient: DownloadData DownloadFile UploadString OpenRead | 0 | high HIGH 8.6 | generic
System.Net.WebRequest: Create | 0 | high HIGH 8.6 | generic aspnet_mvc
System.Net.HttpWebRequest: .ctor | 0 | high HIGH 8.6 | generic
RestSharp.RestClient: .ctor | 0 | medium HIGH 8.6 | generic aspnetcore
RestSharp.RestClient: ExecuteAsync GetAsync | 0 | medium HIGH 8.6 | generic
Flurl.Http.FlurlClient: .ctor | 0 | medium HIGH 8.6 | generic aspnetcore
Flurl.Http.FlurlRequest: GetAsync | 0 | medium HIGH 8.6 | generic
System.Net.Http.SocketsHttpHandler | 0 | low MEDIUM 6.5 | generic
Amazon.S3.AmazonS3Client: .ctor | 0 | low MEDIUM 6.5 | generic
Azure.Storage.Blobs.BlobServiceClient: .ctor | 0 | low MEDIUM 6.5 | generic
System.Net.Dns: GetHostEntry GetHostAddresses | 0 | low MEDIUM 5.3 | generic
Grpc.Net.Client.GrpcChannel: ForAddress | 0 | medium HIGH 7.5 | grpc aspnetcore
= PATH PATH_TRAVERSAL CWE-22
System.IO.File: ReadAllText | 0 | high HIGH 7.5 | generic aspnetcore aspnet_mvc
System.IO.File: ReadAllLines ReadAllBytes WriteAllText | 0 | high HIGH 7.5 | generic aspnetcore
System.IO.File: WriteAllLines WriteAllBytes Open Create Delete | 0 | high HIGH 7.5 | generic
System.IO.File: Move Copy | 0 1 | high HIGH 7.5 | generic
System.IO.File: AppendAllText | 0 | high HIGH 7.5 | generic
System.IO.File: Exists | 0 | low LOW 3.7 | generic
System.IO.FileStream: .ctor | 0 | high HIGH 7.5 | generic aspnetcore
System.IO.StreamReader: .ctor | 0 | high HIGH 7.5 | generic
System.IO.StreamWriter: .ctor | 0 | high HIGH 7.5 | generic
System.IO.BinaryReader: .ctor | 0 | medium HIGH 7.5 | generic
System.IO.BinaryWriter: .ctor | 0 | medium HIGH 7.5 | generic
System.IO.Directory: GetFiles GetDirectories CreateDirectory | 0 | medium MEDIUM 5.3 | generic
System.IO.Directory: Delete | 0 | high HIGH 7.5 | generic
System.IO.Directory: EnumerateFiles | 0 | medium MEDIUM 5.3 | generic
System.IO.Path: Combine | 1 | medium MEDIUM 5.3 | generic aspnetcore
System.IO.Compression.ZipFile: ExtractToDirectory | 0 | medium HIGH 7.5 | generic aspnetcore
System.IO.Compression.ZipArchiveEntry: ExtractToFile | 1 | high HIGH 7.5 | generic
Microsoft.AspNetCore.StaticFiles.StaticFileMiddleware | 0 | low MEDIUM 5.3 | aspnetcore
Microsoft.AspNetCore.Hosting.IWebHostEnvironment: ContentRootPath | 0 | medium HIGH 7.5 | aspnetcore
Microsoft.AspNetCore.Http.IFormFile: CopyToAsync | 0 | high HIGH 7.5 | aspnetcore
= SINK-REFLECT REFLECTION_ABUSE CWE-470
System.Reflection.Assembly: Load LoadFrom | 0 | high CRITICAL 9.8 | generic
System.Activator: CreateInstance | 0 | medium HIGH 8.1 | generic
System.Type: GetType | 0 | medium HIGH 7.5 | generic
= SINK-RAZOR RAZOR_XSS CWE-79
Microsoft.AspNetCore.Html.HtmlString | 0 | high HIGH 6.1 | aspnetcore
Microsoft.AspNetCore.Mvc.Rendering.HtmlHelperExtensions: Raw | 0 | high HIGH 6.1 | aspnetcore aspnet_mvc
System.Web.HtmlString | 0 | high HIGH 6.1 | aspnet_mvc
System.Web.Mvc.HtmlHelper: Raw | 0 | high HIGH 6.1 | aspnet_mvc
"""

# Sources. `family`, then lines `Type: members | label multiplier format [implicit] [authenticated] | frameworks`.
SOURCES = """
= SRC-ASPNET
Microsoft.AspNetCore.Http.IQueryCollection | USER_INPUT 1.0 string | aspnetcore
Microsoft.AspNetCore.Http.HttpRequest: Query QueryString | USER_INPUT 1.0 string | aspnetcore
Microsoft.AspNetCore.Http.IFormCollection | USER_INPUT 1.0 string | aspnetcore
Microsoft.AspNetCore.Http.HttpRequest: Form | USER_INPUT 1.0 string | aspnetcore
Microsoft.AspNetCore.Http.IFormFile | USER_INPUT 1.2 stream | aspnetcore
Microsoft.AspNetCore.Http.IFormFileCollection | USER_INPUT 1.2 stream | aspnetcore
Microsoft.AspNetCore.Http.IHeaderDictionary | USER_INPUT 0.9 string | aspnetcore
Microsoft.AspNetCore.Http.HttpRequest: Headers | USER_INPUT 0.9 string | aspnetcore
Microsoft.AspNetCore.Http.HttpRequest: Body | USER_INPUT 1.0 stream | aspnetcore
Microsoft.AspNetCore.Http.HttpRequest: BodyReader | USER_INPUT 1.0 bytes | aspnetcore
Microsoft.AspNetCore.Routing.RouteData: Values | USER_INPUT 1.0 string | aspnetcore
Microsoft.AspNetCore.Http.HttpRequest: RouteValues | USER_INPUT 1.0 string | aspnetcore
Microsoft.AspNetCore.Http.HttpRequest: Path | USER_INPUT 1.1 string | aspnetcore
Microsoft.AspNetCore.Http.HttpRequest: PathBase | USER_INPUT 1.0 string | aspnetcore
Microsoft.AspNetCore.Http.IRequestCookieCollection | USER_INPUT 0.85 string | aspnetcore
Microsoft.AspNetCore.Http.HttpRequest: Cookies | USER_INPUT 0.85 string | aspnetcore
Microsoft.AspNetCore.Http.HttpContext: Request | USER_INPUT 1.0 object implicit | aspnetcore
Microsoft.AspNetCore.Mvc.ControllerBase: Request | USER_INPUT 1.0 object implicit | aspnetcore
Microsoft.AspNetCore.Http.IHttpContextAccessor: HttpContext | USER_INPUT 1.0 object implicit | aspnetcore
Microsoft.AspNetCore.Http: HttpContext HttpRequest | USER_INPUT 1.0 object implicit | aspnetcore
System.Security.Claims.ClaimsPrincipal | USER_INPUT 0.7 string authenticated | aspnetcore aspnet_mvc
System.Security.Claims.ClaimsIdentity: FindFirst | USER_INPUT 0.7 string authenticated | aspnetcore aspnet_mvc
Microsoft.AspNetCore.SignalR.Hub: Context | USER_INPUT 0.9 object implicit | aspnetcore
= SRC-ASPNET-MVC
System.Web.HttpRequest: QueryString Form | USER_INPUT 1.0 string | aspnet_mvc
System.Web.HttpRequest: Headers | USER_INPUT 0.9 string | aspnet_mvc
System.Web.HttpRequest: Cookies | USER_INPUT 0.85 string | aspnet_mvc
System.Web.HttpRequest: ServerVariables | USER_INPUT 0.8 string | aspnet_mvc
System.Web.HttpRequest: InputStream | USER_INPUT 1.0 stream | aspnet_mvc
System.Web.HttpRequest: Params | USER_INPUT 1.1 string | aspnet_mvc
System.Web.HttpRequest: Files | USER_INPUT 1.2 stream | aspnet_mvc
System.Web.HttpRequest: Url | USER_INPUT 0.9 string | aspnet_mvc
System.Web.Mvc.Controller: Request | USER_INPUT 1.0 object implicit | aspnet_mvc
= SRC-ASPNET-WF
System.Web.UI.Page: Request | USER_INPUT 1.0 object implicit | aspnet_mvc
System.Web.UI.WebControls.TextBox: Text | USER_INPUT 0.95 string | aspnet_mvc
= SRC-CON
System.Console: ReadLine | USER_INPUT 1.0 string | console generic
System.Console: Read | USER_INPUT 0.9 string | console generic
System.Console: ReadKey | USER_INPUT 0.7 string | console generic
System.Console: In OpenStandardInput | USER_INPUT 1.0 stream | console generic
System.Environment: GetCommandLineArgs CommandLine | USER_INPUT 1.0 string | console generic
System.Environment: GetCommandLineArgs | USER_INPUT 1.0 string implicit | console generic
System.Environment: GetEnvironmentVariable | ENVIRONMENT_INPUT 0.75 string | console generic aspnetcore
System.Environment: GetEnvironmentVariables | ENVIRONMENT_INPUT 0.75 object | console generic
System.Net.Sockets: TcpClient | NETWORK_INPUT 1.1 stream | console generic
System.Net.Sockets: TcpListener | NETWORK_INPUT 1.2 stream | console generic
System.Net.Sockets: NetworkStream | NETWORK_INPUT 1.1 stream | console generic
System.Net.Sockets: UdpClient | NETWORK_INPUT 1.1 bytes | console generic
System.Net.Sockets.Socket: Receive ReceiveAsync | NETWORK_INPUT 1.2 bytes | console generic
System.IO.Pipes: NamedPipeServerStream | NETWORK_INPUT 0.9 stream | console generic
System.IO.Pipes: NamedPipeClientStream | EXTERNAL_INPUT 0.8 stream | console generic
System.IO.Pipes: AnonymousPipeServerStream | NETWORK_INPUT 0.8 stream | console generic
System.IO.StreamReader: ReadToEnd | EXTERNAL_INPUT 0.85 string | console generic aspnetcore
System.IO.StreamReader: ReadLine | EXTERNAL_INPUT 0.85 string | console generic
System.IO.StreamReader: ReadAsync | EXTERNAL_INPUT 0.85 string | console generic aspnetcore
System.IO.File: ReadAllText | STORED_INPUT 0.7 string | console generic aspnetcore
System.Data.SqlClient.SqlDataReader: GetString | STORED_INPUT 0.65 string | generic aspnetcore aspnet_mvc
System.Data.SqlClient.SqlDataReader: GetValue | STORED_INPUT 0.65 string | generic aspnetcore
Microsoft.Data.SqlClient.SqlDataReader: GetString | STORED_INPUT 0.65 string | generic aspnetcore
System.Data.DataRow: Item | STORED_INPUT 0.65 string | generic aspnetcore
System.Messaging.Message: Body | EXTERNAL_INPUT 0.9 object | generic
RabbitMQ.Client.Events.BasicDeliverEventArgs | EXTERNAL_INPUT 0.9 bytes | generic aspnetcore
Azure.Messaging.ServiceBus.ServiceBusReceivedMessage | EXTERNAL_INPUT 0.8 bytes authenticated | generic aspnetcore
Confluent.Kafka.ConsumeResult | EXTERNAL_INPUT 0.9 bytes | generic aspnetcore
Microsoft.Win32.RegistryKey: GetValue | ENVIRONMENT_INPUT 0.7 string | console generic
Grpc.Core.ServerCallContext | USER_INPUT 0.9 object implicit | grpc aspnetcore
Grpc.Core.Metadata | USER_INPUT 0.85 string | grpc aspnetcore
System.Net.Http.HttpResponseMessage: Content | EXTERNAL_INPUT 0.8 stream | console generic aspnetcore
System.Net.WebClient: DownloadString | EXTERNAL_INPUT 0.8 string | console generic
Microsoft.Extensions.Configuration.IConfiguration | ENVIRONMENT_INPUT 0.6 string | console generic aspnetcore
System.Configuration.ConfigurationManager: AppSettings | ENVIRONMENT_INPUT 0.55 string | console aspnet_mvc generic
System.Net.Dns: GetHostEntry | EXTERNAL_INPUT 0.7 string | console generic aspnetcore
System.Diagnostics.Process: StandardOutput | EXTERNAL_INPUT 0.85 stream | console generic
System.Diagnostics.Process: StandardError | EXTERNAL_INPUT 0.7 stream | console generic
= SRC-WCF
System.ServiceModel.OperationContext | USER_INPUT 1.0 object implicit | wcf
System.ServiceModel.OperationContext: IncomingMessageHeaders | USER_INPUT 0.9 object | wcf
System.ServiceModel.OperationContext: IncomingMessageProperties | USER_INPUT 0.85 object | wcf
System.ServiceModel.OperationContext: RequestContext | USER_INPUT 1.0 object | wcf
System.ServiceModel.Channels: Message | USER_INPUT 1.1 object | wcf
System.ServiceModel.Channels: MessageHeaders | USER_INPUT 0.9 object | wcf
System.ServiceModel.Channels.MessageBuffer: CreateMessage | USER_INPUT 1.0 object | wcf
System.ServiceModel.Web: WebOperationContext | USER_INPUT 1.0 object implicit | wcf
System.ServiceModel.Web: IncomingWebRequestContext | USER_INPUT 1.0 object | wcf
System.ServiceModel.Web.IncomingWebRequestContext: UriTemplateMatch | USER_INPUT 1.0 string | wcf
System.ServiceModel.Dispatcher: IParameterInspector | USER_INPUT 1.0 object implicit | wcf
System.ServiceModel.Dispatcher: IMessageInspector | USER_INPUT 1.1 object implicit | wcf
System.ServiceModel.Dispatcher: EndpointDispatcher | USER_INPUT 0.8 object implicit | wcf
CoreWCF.OperationContext | USER_INPUT 1.0 object implicit | wcf
CoreWCF.Channels.Message | USER_INPUT 1.1 object | wcf
System.ServiceModel.ServiceSecurityContext | USER_INPUT 0.7 object authenticated | wcf
System.ServiceModel.ServiceSecurityContext: PrimaryIdentity | USER_INPUT 0.7 string authenticated | wcf
"""

# Sanitizers. `family type`, then lines `Type: members | kinds | contexts | confidence | frameworks`.
SANITIZERS = """
= SAN-ENC ENCODING
System.Net.WebUtility: HtmlEncode | RAZOR_XSS XSS | html_body html_attribute html_comment | 0.95 | generic aspnetcore aspnet_mvc
System.Web.HttpUtility: HtmlEncode | RAZOR_XSS XSS | html_body html_attribute | 0.95 | aspnet_mvc
System.Text.Encodings.Web.HtmlEncoder: Encode | RAZOR_XSS XSS | html_body html_attribute html_comment | 0.98 | aspnetcore
System.Text.Encodings.Web.HtmlEncoder: Default | RAZOR_XSS XSS | html_body html_attribute | 0.98 | aspnetcore
Microsoft.Security.Application.Encoder: HtmlEncode | RAZOR_XSS XSS | html_body html_attribute | 0.99 | aspnet_mvc generic
Microsoft.Security.Application.Encoder: HtmlAttributeEncode | RAZOR_XSS XSS | html_attribute | 0.99 | aspnet_mvc
System.Text.Encodings.Web.JavaScriptEncoder: Encode | XSS | javascript_string json_value | 0.95 | aspnetcore aspnet_mvc
System.Text.Encodings.Web.JavaScriptEncoder: Default | XSS | javascript_string | 0.95 | aspnetcore
Microsoft.Security.Application.Encoder: JavaScriptEncode | XSS | javascript_string | 0.99 | aspnet_mvc
System.Text.Encodings.Web.UrlEncoder: Encode | OPEN_REDIRECT XSS | url_query_value url_path_segment | 0.90 | aspnetcore
System.Net.WebUtility: UrlEncode | OPEN_REDIRECT | url_query_value | 0.88 | generic aspnetcore
System.Web.HttpUtility: UrlEncode | OPEN_REDIRECT | url_query_value | 0.88 | aspnet_mvc
System.Uri: EscapeDataString | OPEN_REDIRECT XSS | url_query_value url_path_segment | 0.92 | generic aspnetcore
Microsoft.Security.Application.Encoder: UrlEncode | OPEN_REDIRECT XSS | url_query_value | 0.95 | aspnet_mvc
System.Uri: EscapeUriString | OPEN_REDIRECT | url_full | 0.70 | generic
System.Security.SecurityElement: Escape | XXE XSS | xml_text xml_attribute | 0.90 | generic aspnetcore
System.Xml.XmlConvert: EncodeName | XXE | xml_element_name xml_attribute_name | 0.85 | generic
Ganss.Xss.HtmlSanitizer: Sanitize | RAZOR_XSS XSS | html_body html_rich_text | 0.97 | generic aspnetcore aspnet_mvc
Microsoft.AspNetCore.Html.HtmlContentBuilder: Append | RAZOR_XSS XSS | html_body | 0.98 | aspnetcore
System.Text.RegularExpressions.Regex: Replace | LOG_INJECTION | log_entry | 0.75 | generic aspnetcore
System.String: Replace | LOG_INJECTION XSS | log_entry html_text | 0.50 | generic
System.Net.WebUtility: HtmlEncode | XSS | http_header_value | 0.80 | generic
Microsoft.Security.Application.Encoder: CssEncode | XSS | css_value css_property | 0.95 | aspnet_mvc
Microsoft.Security.Application.Encoder: UrlPathEncode | PATH_TRAVERSAL OPEN_REDIRECT | url_path_segment | 0.80 | aspnet_mvc
Microsoft.AspNetCore.Mvc.Razor.RazorPage: WriteLiteral | RAZOR_XSS XSS | html_body html_attribute | 0.99 | aspnetcore
System.Web.HttpServerUtility: HtmlEncode | XSS RAZOR_XSS | html_body | 0.92 | aspnet_mvc
= SAN-VAL VALIDATION
System.Int32: TryParse | SQL_INJECTION COMMAND_INJECTION PATH_TRAVERSAL XSS OPEN_REDIRECT LOG_INJECTION | sql_query command_argument file_path html_body url_value log_entry | 0.97 | generic aspnetcore aspnet_mvc wcf
System.Int64: TryParse | SQL_INJECTION COMMAND_INJECTION PATH_TRAVERSAL XSS LOG_INJECTION | sql_query command_argument file_path log_entry | 0.97 | generic aspnetcore aspnet_mvc
System.Int16: TryParse | SQL_INJECTION COMMAND_INJECTION LOG_INJECTION | sql_query command_argument log_entry | 0.97 | generic
System.UInt32: TryParse | SQL_INJECTION COMMAND_INJECTION PATH_TRAVERSAL | sql_query command_argument file_path | 0.98 | generic aspnetcore
System.Double: TryParse | SQL_INJECTION LOG_INJECTION | sql_query log_entry | 0.92 | generic
System.Decimal: TryParse | SQL_INJECTION LOG_INJECTION | sql_query log_entry | 0.95 | generic aspnetcore
System.Boolean: TryParse | SQL_INJECTION COMMAND_INJECTION LOG_INJECTION | sql_query command_argument log_entry | 0.99 | generic aspnetcore
System.Guid: TryParse | SQL_INJECTION COMMAND_INJECTION PATH_TRAVERSAL XSS SSRF LOG_INJECTION | sql_query command_argument file_path url_value log_entry html_body | 0.99 | generic aspnetcore aspnet_mvc wcf
System.Guid: TryParseExact | SQL_INJECTION COMMAND_INJECTION PATH_TRAVERSAL XSS LOG_INJECTION | sql_query command_argument file_path log_entry | 0.99 | generic aspnetcore
System.Enum: TryParse | SQL_INJECTION COMMAND_INJECTION PATH_TRAVERSAL XSS LOG_INJECTION | sql_query command_argument file_path html_body log_entry | 0.96 | generic aspnetcore aspnet_mvc
System.Enum: IsDefined | SQL_INJECTION COMMAND_INJECTION XSS | sql_query command_argument html_body | 0.88 | generic aspnetcore
System.DateTime: TryParse | SQL_INJECTION LOG_INJECTION | sql_query log_entry | 0.90 | generic aspnetcore
System.DateTime: TryParseExact | SQL_INJECTION LOG_INJECTION | sql_query log_entry | 0.95 | generic aspnetcore
System.DateTimeOffset: TryParse | SQL_INJECTION LOG_INJECTION | sql_query log_entry | 0.90 | generic aspnetcore
System.TimeSpan: TryParse | SQL_INJECTION LOG_INJECTION | sql_query log_entry | 0.93 | generic
System.IO.Path: GetFileName | PATH_TRAVERSAL | file_path | 0.80 | generic aspnetcore aspnet_mvc
System.IO.Path: GetFullPath | PATH_TRAVERSAL | file_path | 0.82 | generic aspnetcore
System.IO.Path: GetExtension | PATH_TRAVERSAL | file_path | 0.65 | generic aspnetcore
System.IO.Path: GetFileNameWithoutExtension | PATH_TRAVERSAL | file_path | 0.78 | generic aspnetcore
Microsoft.AspNetCore.Mvc.IUrlHelper: IsLocalUrl | OPEN_REDIRECT | url_value redirect_url | 0.96 | aspnetcore
System.Uri: TryCreate | SSRF OPEN_REDIRECT | url_value | 0.72 | generic aspnetcore
System.Uri: IsWellFormedUriString | OPEN_REDIRECT | url_value | 0.60 | generic
System.Text.RegularExpressions.Regex: IsMatch | SQL_INJECTION COMMAND_INJECTION PATH_TRAVERSAL XSS LOG_INJECTION | sql_query command_argument file_path html_body log_entry | 0.70 | generic aspnetcore aspnet_mvc
System.Text.RegularExpressions.Regex: Match | SQL_INJECTION COMMAND_INJECTION XSS | sql_query command_argument html_body | 0.65 | generic
System.ComponentModel.DataAnnotations.Validator: TryValidateObject | SQL_INJECTION XSS COMMAND_INJECTION | sql_query html_body command_argument | 0.75 | aspnetcore aspnet_mvc
Microsoft.AspNetCore.Mvc.ControllerBase: ModelState | SQL_INJECTION XSS COMMAND_INJECTION | sql_query html_body command_argument | 0.75 | aspnetcore
System.ComponentModel.DataAnnotations: EmailAddressAttribute | SQL_INJECTION XSS LOG_INJECTION | sql_query html_body log_entry | 0.80 | aspnetcore aspnet_mvc
System.ComponentModel.DataAnnotations: RangeAttribute | SQL_INJECTION COMMAND_INJECTION | sql_query command_argument | 0.88 | aspnetcore aspnet_mvc
System.Web.Mvc.ValidateInputAttribute | XSS RAZOR_XSS | html_body | 0.82 | aspnet_mvc
Microsoft.AspNetCore.Antiforgery.IAntiforgery: ValidateRequestAsync | CSRF | csrf_token | 0.96 | aspnetcore
System.IdentityModel.Tokens.Jwt.JwtSecurityTokenHandler: ValidateToken | SQL_INJECTION XSS | sql_query html_body | 0.78 | aspnetcore generic
System.Net.IPAddress: TryParse | COMMAND_INJECTION SQL_INJECTION LOG_INJECTION | command_argument sql_query log_entry | 0.93 | generic aspnetcore
FluentValidation.AbstractValidator: Validate | SQL_INJECTION XSS COMMAND_INJECTION PATH_TRAVERSAL | sql_query html_body command_argument file_path | 0.75 | generic aspnetcore
FluentValidation.AbstractValidator: ValidateAsync | SQL_INJECTION XSS COMMAND_INJECTION | sql_query html_body command_argument | 0.75 | generic aspnetcore
= SAN-PARAM PARAMETERIZATION
System.Data.SqlClient.SqlParameter | SQL_INJECTION | sql_parameter | 1.0 | generic aspnetcore aspnet_mvc wcf
System.Data.SqlClient.SqlCommand: Parameters | SQL_INJECTION | sql_parameter | 1.0 | generic aspnetcore aspnet_mvc
System.Data.SqlClient.SqlDataAdapter | SQL_INJECTION | sql_parameter | 0.95 | generic aspnetcore
Microsoft.Data.SqlClient.SqlParameter | SQL_INJECTION | sql_parameter | 1.0 | generic aspnetcore
Microsoft.Data.SqlClient.SqlCommand: Parameters | SQL_INJECTION | sql_parameter | 1.0 | generic aspnetcore
System.Data.OleDb.OleDbParameter | SQL_INJECTION | sql_parameter | 1.0 | generic
System.Data.Odbc.OdbcParameter | SQL_INJECTION | sql_parameter | 1.0 | generic
Microsoft.EntityFrameworkCore.RelationalQueryableExtensions: FromSqlInterpolated ExecuteSqlInterpolated | SQL_INJECTION | orm_parameterized_query | 0.98 | ef_core aspnetcore
Microsoft.EntityFrameworkCore.DbContext: Database.ExecuteSqlInterpolated | SQL_INJECTION | orm_parameterized_query | 0.98 | ef_core
Microsoft.EntityFrameworkCore.RelationalQueryableExtensions: FromSql | SQL_INJECTION | orm_parameterized_query | 0.98 | ef_core aspnetcore
System.Linq.Queryable: Where Select FirstOrDefault | SQL_INJECTION | orm_linq_query | 1.0 | ef_core ef6 aspnetcore
Dapper.SqlMapper: Execute Query | SQL_INJECTION | sql_parameter | 0.98 | dapper generic aspnetcore
Dapper.SqlMapper: QueryAsync ExecuteAsync | SQL_INJECTION | sql_parameter | 0.98 | dapper aspnetcore
Dapper.DynamicParameters | SQL_INJECTION | sql_parameter | 0.97 | dapper
System.Data.CommandType: StoredProcedure | SQL_INJECTION | stored_procedure | 0.97 | generic aspnetcore aspnet_mvc
System.Data.SqlClient.SqlCommand: CommandType | SQL_INJECTION | stored_procedure | 0.97 | generic aspnetcore
System.Data.Entity.Database: SqlQuery ExecuteSqlCommand | SQL_INJECTION | sql_parameter | 0.95 | ef6
NHibernate.IQuery: SetParameter | SQL_INJECTION | sql_parameter | 0.97 | generic
NHibernate.ISQLQuery: SetParameter | SQL_INJECTION | sql_parameter | 0.97 | generic
NPoco.Database: Execute | SQL_INJECTION | sql_parameter | 0.97 | generic
System.Text.Json.JsonSerializer: Deserialize | INSECURE_DESERIALIZATION | type_safe_deserialization | 0.97 | generic aspnetcore
System.Runtime.Serialization.DataContractSerializer: ReadObject | INSECURE_DESERIALIZATION | type_safe_deserialization | 0.88 | generic wcf aspnetcore
System.Xml.Serialization.XmlSerializer | INSECURE_DESERIALIZATION | type_safe_deserialization | 0.90 | generic aspnetcore wcf
Newtonsoft.Json.JsonConvert: DeserializeObject | INSECURE_DESERIALIZATION | type_safe_deserialization | 0.85 | generic aspnetcore
MessagePack.MessagePackSerializer: Deserialize | INSECURE_DESERIALIZATION | type_safe_deserialization | 0.88 | generic aspnetcore
System.Diagnostics.ProcessStartInfo: ArgumentList | COMMAND_INJECTION | command_argument_list | 0.92 | generic aspnetcore
System.Xml.XmlReaderSettings | XXE | xml_parser_config | 0.98 | generic aspnetcore wcf
System.Xml.XmlDocument: XmlResolver | XXE | xml_parser_config | 0.95 | generic aspnetcore
System.DirectoryServices.DirectorySearcher | SQL_INJECTION | ldap_filter | 0.80 | generic aspnetcore
"""

# Tags a filter asks for that the symbol's own words do not give.
EXTRA_TAGS = {
    "System.IO.StreamWriter..ctor": ["write"], "System.IO.BinaryWriter..ctor": ["write"],
    "Microsoft.AspNetCore.Http.IFormFile.CopyToAsync": ["upload"],
    "Microsoft.AspNetCore.Http.IFormFile": ["upload"],
    "Microsoft.AspNetCore.Http.IFormFileCollection": ["upload"],
    "System.Web.HttpRequest.Files": ["upload"],
    "System.Messaging.Message.Body": ["messaging", "queue"],
    "RabbitMQ.Client.Events.BasicDeliverEventArgs": ["messaging", "queue"],
    "Azure.Messaging.ServiceBus.ServiceBusReceivedMessage": ["messaging"],
    "Confluent.Kafka.ConsumeResult": ["messaging"],
    "System.Net.Dns.GetHostEntry": ["network"],
}
TYPE_TAGS = {
    "Int32": "integer", "Int64": "long", "Int16": "integer", "UInt32": "integer", "Double": "double",
    "Decimal": "decimal", "Boolean": "boolean", "Guid": "guid", "DateTime": "datetime",
    "DateTimeOffset": "datetimeoffset", "TimeSpan": "timespan", "IPAddress": "ipaddress",
}
# ------------------------------------------------------------------------------------------

_BLANK = dict.fromkeys(c.split()[0] for c in RULE_SCHEMA.split(", "))


def _lines(text: str):
    """(family header words, symbol, the fields after the symbol) per rule, in order."""
    head: list[str] = []
    for line in text.strip().splitlines():
        if line.startswith("="):
            head = line[1:].split()
            continue
        where, *fields = [part.strip() for part in line.split("|")]
        owner, _, members = where.partition(":")
        for symbol in [f"{owner}.{m}" for m in members.split()] or [owner]:
            yield head, symbol, fields


def _tags(symbol: str, extra: list[str]) -> list[str]:
    words = re.findall(r"[A-Z][a-z]+|[A-Z]+(?![a-z])", ".".join(symbol.split(".")[-2:]))
    return list(dict.fromkeys([w.lower() for w in words] + extra + EXTRA_TAGS.get(symbol, [])))


def catalog_rows() -> list[dict]:
    """The whole catalogue as dicts, in load order."""
    counts: dict[str, int] = {}
    rows: list[dict] = []

    def add(family: str, rule_type: str, symbol: str, frameworks: str, extra_tags: list[str], **fields) -> None:
        counts[family] = counts.get(family, 0) + 1
        rows.append({
            **_BLANK, "ordinal": len(rows) + 1, "id": f"{family}-{counts[family]:03d}", "rule_type": rule_type,
            "symbol": symbol, "name": ".".join(symbol.split(".")[-2:]), "frameworks": frameworks.split(),
            "tags": _tags(symbol, extra_tags), "is_custom": False, **fields,
        })

    for (family, kind, cwe), symbol, (args, grade, frameworks) in _lines(SINKS):
        *always, level, severity, score = grade.split()
        words = kind.lower().replace("_", " ")
        add(family, "sink", symbol, frameworks, words.split(), vulnerability=kind, cwe=cwe,
            tainted_args=[int(a) for a in args.split()], always_vulnerable=bool(always),
            confidence_level=level, severity=severity, cvss_base=float(score),
            description=f"Data an attacker controls may reach {symbol} ({words}).",
            remediation=f"Validate or parameterise the input before calling {symbol}.")
    for (family,), symbol, (grade, frameworks) in _lines(SOURCES):
        label, multiplier, data_format, *flags = grade.split()
        extra = {"NETWORK_INPUT": ["network"], "STORED_INPUT": ["second-order"]}.get(label, [])
        add(family, "source", symbol, frameworks, extra, taint_label=label, severity_multiplier=float(multiplier),
            data_format=data_format, implicit="implicit" in flags,
            authentication_context="authenticated" if "authenticated" in flags else "any",
            description=f"{symbol} returns data from outside the program.")
    for (family, kind), symbol, (kinds, contexts, score, frameworks) in _lines(SANITIZERS):
        extra = [t for name, t in TYPE_TAGS.items() if f".{name}." in symbol]
        add(family, "sanitizer", symbol, frameworks, extra + (["linq"] if ".Linq." in symbol else []),
            sanitizes=kinds.split(), encoding_context=contexts.split(), sanitizer_type=kind,
            confidence_score=float(score), description=f"{symbol} neutralises {kinds.lower()}.")
    return rows


def load_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The rule table: the built-in catalogue, or a JSON or Parquet table of the same columns."""
    if path is not None:
        reader = spark.read.schema(RULE_SCHEMA)
        return reader.parquet(path) if path.endswith(".parquet") else reader.json(path)
    rows = catalog_rows()
    return spark.createDataFrame([tuple(r.values()) for r in rows], RULE_SCHEMA)


# --- fixed values: coarse role prefixes used to flag nodes before rules are applied --------
ROLE_SINKS = """
System.Data.SqlClient.SqlCommand Microsoft.Data.SqlClient.SqlCommand System.Data.OleDb.OleDbCommand
System.Data.Odbc.OdbcCommand Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.FromSqlRaw
Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.ExecuteSqlRaw Dapper.SqlMapper.
System.Diagnostics.Process.Start System.IO.File.
System.Runtime.Serialization.Formatters.Binary.BinaryFormatter
System.Web.Script.Serialization.JavaScriptSerializer.Deserialize
Newtonsoft.Json.JsonConvert.DeserializeObject System.Xml.XmlDocument.Load System.Xml.XmlTextReader
System.Net.Http.HttpClient. System.Net.WebClient. System.Reflection.Assembly.Load
System.Activator.CreateInstance Microsoft.AspNetCore.Html.HtmlString System.Web.HtmlString
""".split()
ROLE_SOURCES = """
Microsoft.AspNetCore.Http.IQueryCollection Microsoft.AspNetCore.Http.IFormCollection
Microsoft.AspNetCore.Http.IHeaderDictionary Microsoft.AspNetCore.Http.HttpRequest.
Microsoft.AspNetCore.Routing.RouteData System.Web.HttpRequest. System.Console.ReadLine
System.Environment.GetCommandLineArgs Microsoft.AspNetCore.Http.IFormFile.FileName
""".split()
ROLE_SANITIZERS = """
System.Data.SqlClient.SqlParameter Microsoft.Data.SqlClient.SqlParameter
System.Data.SqlClient.SqlCommand.AddWithValue Microsoft.Data.SqlClient.SqlCommand.AddWithValue
System.Data.SqlClient.SqlCommand.Parameters Microsoft.Data.SqlClient.SqlCommand.Parameters
System.Net.WebUtility.HtmlEncode System.Web.HttpUtility.HtmlEncode
System.Text.Encodings.Web.HtmlEncoder.Encode System.IO.Path.GetFileName System.IO.Path.GetFullPath
System.Int32.TryParse System.Guid.TryParse
""".split()
# Sink prefix -> kind, for taint findings; the first match in this order counts.
SINK_KINDS = """
System.Data.SqlClient.SqlCommand SQL_INJECTION
Microsoft.Data.SqlClient.SqlCommand SQL_INJECTION
System.Data.OleDb.OleDbCommand SQL_INJECTION
System.Data.Odbc.OdbcCommand SQL_INJECTION
Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.FromSqlRaw SQL_INJECTION
Microsoft.EntityFrameworkCore.RelationalQueryableExtensions.ExecuteSqlRaw SQL_INJECTION
Dapper.SqlMapper.Execute SQL_INJECTION
Dapper.SqlMapper.Query SQL_INJECTION
System.Diagnostics.Process.Start COMMAND_INJECTION
System.Diagnostics.ProcessStartInfo COMMAND_INJECTION
System.IO.File.ReadAllText PATH_TRAVERSAL
System.IO.File.WriteAllText PATH_TRAVERSAL
System.IO.File.Open PATH_TRAVERSAL
System.IO.File.Delete PATH_TRAVERSAL
System.IO.File.ReadAllBytes PATH_TRAVERSAL
System.IO.FileStream PATH_TRAVERSAL
System.IO.StreamReader PATH_TRAVERSAL
System.Runtime.Serialization.Formatters.Binary.BinaryFormatter.Deserialize INSECURE_DESERIALIZATION
System.Runtime.Serialization.Formatters.Soap.SoapFormatter.Deserialize INSECURE_DESERIALIZATION
System.Web.Script.Serialization.JavaScriptSerializer.Deserialize INSECURE_DESERIALIZATION
Newtonsoft.Json.JsonConvert.DeserializeObject INSECURE_DESERIALIZATION
System.Xml.Serialization.XmlSerializer.Deserialize INSECURE_DESERIALIZATION
System.Runtime.Serialization.DataContractSerializer.ReadObject INSECURE_DESERIALIZATION
System.Xml.XmlDocument.Load XXE
System.Xml.XmlTextReader XXE
System.Xml.XmlReader.Create XXE
System.Xml.Linq.XDocument.Load XXE
System.Net.Http.HttpClient.GetAsync SSRF
System.Net.Http.HttpClient.PostAsync SSRF
System.Net.Http.HttpClient.SendAsync SSRF
System.Net.WebClient.DownloadString SSRF
System.Net.WebRequest.Create SSRF
RestSharp.RestClient SSRF
System.Reflection.Assembly.Load REFLECTION_ABUSE
System.Activator.CreateInstance REFLECTION_ABUSE
System.Type.GetType REFLECTION_ABUSE
Microsoft.AspNetCore.Html.HtmlString RAZOR_XSS
Microsoft.AspNetCore.Mvc.Rendering.HtmlHelperExtensions.Raw RAZOR_XSS
System.Web.HtmlString RAZOR_XSS
System.Web.Mvc.HtmlHelper.Raw RAZOR_XSS
""".split()
# ------------------------------------------------------------------------------------------


def load_roles(spark: SparkSession) -> DataFrame:
    rows = [(s, t) for t, names in (("sink", ROLE_SINKS), ("source", ROLE_SOURCES), ("sanitizer", ROLE_SANITIZERS)) for s in names]
    return spark.createDataFrame(rows, "symbol string, rule_type string")


def load_sink_kinds(spark: SparkSession) -> DataFrame:
    pairs = list(zip(SINK_KINDS[::2], SINK_KINDS[1::2]))
    return spark.createDataFrame([(i, p, k) for i, (p, k) in enumerate(pairs)], "ordinal int, symbol string, vulnerability_kind string")
