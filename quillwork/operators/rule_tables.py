"""Rule tables: literal patterns in order of precedence, the first that a line contains wins."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    id: str
    category: str
    confidence: str
    severity: str
    pattern: str
    also: str


# Rule identifiers, severities and literal patterns.
SAST = (
    Rule('SAST-SQL-001', 'sql_injection', 'medium', 'high', 'format!("SELECT', ''),
    Rule('SAST-SQL-002', 'sql_injection', 'medium', 'high', 'format!("INSERT', ''),
    Rule('SAST-SQL-003', 'sql_injection', 'medium', 'high', 'format!("UPDATE', ''),
    Rule('SAST-SQL-004', 'sql_injection', 'medium', 'high', 'format!("DELETE', ''),
    Rule('SAST-SQL-005', 'sql_injection', 'high', 'critical', 'execute(', 'format!('),
    Rule('SAST-PATH-001', 'path_traversal', 'medium', 'high', 'Path::new(', 'request'),
    Rule('SAST-PATH-002', 'path_traversal', 'medium', 'high', 'read_to_string(', 'param'),
    Rule('SAST-PATH-003', 'path_traversal', 'high', 'critical', '../', 'user'),
    Rule('SAST-PATH-004', 'path_traversal', 'low', 'medium', 'join(', 'input'),
    Rule('SAST-PATH-005', 'path_traversal', 'low', 'medium', 'open(', 'input'),
    Rule('SAST-CMD-001', 'cmd_injection', 'high', 'critical', 'Command::new(', 'input'),
    Rule('SAST-CMD-002', 'cmd_injection', 'high', 'critical', 'Command::new(', 'request'),
    Rule('SAST-CMD-003', 'cmd_injection', 'medium', 'high', '.arg(', 'input'),
    Rule('SAST-CMD-004', 'cmd_injection', 'high', 'critical', 'shell(', ''),
    Rule('SAST-EVAL-001', 'code_execution', 'high', 'critical', 'eval(', ''),
    Rule('SAST-EVAL-002', 'code_execution', 'high', 'critical', 'exec(', 'input'),
    Rule('SAST-DESER-001', 'unsafe_deser', 'medium', 'high', 'from_slice(', 'request'),
    Rule('SAST-DESER-002', 'unsafe_deser', 'low', 'medium', 'unsafe {', ''),
    Rule('SAST-DESER-003', 'unsafe_deser', 'medium', 'high', 'pickle.loads(', ''),
    Rule('SAST-SSRF-001', 'ssrf', 'medium', 'high', 'reqwest::get(', 'input'),
    Rule('SAST-SSRF-002', 'ssrf', 'medium', 'high', 'fetch(', 'param'),
    Rule('SAST-XSS-001', 'xss', 'medium', 'high', 'innerHTML', 'input'),
    Rule('SAST-XSS-002', 'xss', 'high', 'critical', 'dangerouslySetInnerHTML', ''),
    Rule('SAST-XSS-003', 'xss', 'medium', 'high', 'document.write(', ''),
    Rule('SAST-PY-CMD-001', 'cmd_injection', 'high', 'critical', 'os.system(', ''),
    Rule('SAST-PY-CMD-002', 'cmd_injection', 'high', 'critical', 'subprocess.call(', 'shell=True'),
    Rule('SAST-PY-EVAL-001', 'code_execution', 'high', 'critical', 'eval(', ''),
    Rule('SAST-PY-DESER-001', 'unsafe_deser', 'high', 'critical', 'yaml.load(', ''),
    Rule('SAST-PY-DESER-002', 'unsafe_deser', 'high', 'critical', 'marshal.loads(', ''),
    Rule('SAST-JS-EVAL-001', 'code_execution', 'high', 'critical', 'setTimeout(', '"'),
    Rule('SAST-JS-EVAL-002', 'code_execution', 'high', 'critical', 'setInterval(', '"'),
    Rule('SAST-JS-EVAL-003', 'code_execution', 'high', 'critical', 'new Function(', ''),
    Rule('SAST-GO-CMD-001', 'cmd_injection', 'medium', 'high', 'exec.Command(', 'sh'),
    Rule('SAST-GO-UNSAFE-001', 'unsafe_deser', 'medium', 'high', 'unsafe.Pointer', ''),
    Rule('SAST-JAVA-CMD-001', 'cmd_injection', 'high', 'critical', 'Runtime.getRuntime().exec(', ''),
    Rule('SAST-JAVA-DESER-001', 'unsafe_deser', 'high', 'critical', 'ObjectInputStream', 'readObject'),
    Rule('SAST-JAVA-EVAL-001', 'code_execution', 'high', 'critical', 'ScriptEngine', 'eval'),
    Rule('SAST-JAVA-XSS-001', 'xss', 'medium', 'high', 'response.getWriter().print(', ''),
    Rule('SAST-PHP-SQL-001', 'sql_injection', 'high', 'critical', 'mysql_query(', ''),
    Rule('SAST-PHP-EVAL-001', 'code_execution', 'high', 'critical', 'eval($', ''),
    Rule('SAST-SOL-REENT-001', 'reentrancy', 'high', 'critical', 'call{value:', 'balance'),
    Rule('SAST-SOL-REENT-002', 'reentrancy', 'high', 'critical', 'transfer(', '.send('),
    Rule('SAST-SOL-ACL-001', 'access_control', 'medium', 'high', 'selfdestruct(', ''),
    Rule('SAST-SOL-ACL-002', 'access_control', 'high', 'critical', 'tx.origin', 'owner'),
    Rule('SAST-SOL-ACL-003', 'access_control', 'medium', 'high', 'function ', 'public'),
    Rule('SAST-SOL-TIME-001', 'timestamp', 'medium', 'medium', 'block.timestamp', ''),
    Rule('SAST-SOL-SEND-001', 'unchecked_send', 'high', 'high', '.send(', ''),
    Rule('SAST-SOL-SEND-002', 'unchecked_send', 'high', 'high', '.call{value:', ''),
    Rule('SAST-SOL-INT-001', 'integer_overflow', 'low', 'medium', 'unchecked {', ''),
)
CRYPTO = (
    Rule('CRYPTO-HASH-001', 'weak_hash', 'high', 'high', 'Md5::', ''),
    Rule('CRYPTO-HASH-002', 'weak_hash', 'high', 'high', 'md5(', ''),
    Rule('CRYPTO-HASH-003', 'weak_hash', 'high', 'high', 'hashlib.md5(', ''),
    Rule('CRYPTO-HASH-004', 'weak_hash', 'high', 'high', 'hashlib.sha1(', ''),
    Rule('CRYPTO-HASH-005', 'weak_hash', 'high', 'high', 'Sha1::', ''),
    Rule('CRYPTO-HASH-006', 'weak_hash', 'high', 'high', 'MessageDigest.getInstance("MD5")', ''),
    Rule('CRYPTO-HASH-007', 'weak_hash', 'high', 'high', 'MessageDigest.getInstance("SHA-1")', ''),
    Rule('CRYPTO-RAND-001', 'insecure_random', 'high', 'high', 'rand::random()', ''),
    Rule('CRYPTO-RAND-002', 'insecure_random', 'high', 'high', 'random.random()', ''),
    Rule('CRYPTO-RAND-003', 'insecure_random', 'high', 'high', 'Math.random()', ''),
    Rule('CRYPTO-RAND-004', 'insecure_random', 'high', 'high', 'new Random()', ''),
    Rule('CRYPTO-RAND-005', 'insecure_random', 'high', 'high', 'rand.Intn(', ''),
    Rule('CRYPTO-IV-001', 'hardcoded_iv', 'high', 'critical', 'iv = b"', ''),
    Rule('CRYPTO-IV-002', 'hardcoded_iv', 'high', 'critical', 'let iv = [0', ''),
    Rule('CRYPTO-IV-003', 'hardcoded_iv', 'high', 'critical', 'nonce = b"', ''),
    Rule('CRYPTO-CIPHER-001', 'weak_cipher', 'high', 'critical', 'AES_ECB', ''),
    Rule('CRYPTO-CIPHER-002', 'weak_cipher', 'high', 'critical', '"ECB"', ''),
    Rule('CRYPTO-CIPHER-003', 'weak_cipher', 'high', 'critical', 'Cipher.getInstance("AES")', ''),
    Rule('CRYPTO-CIPHER-004', 'weak_cipher', 'high', 'high', 'DES', 'Cipher'),
    Rule('CRYPTO-CIPHER-005', 'weak_cipher', 'high', 'high', 'RC4', ''),
    Rule('CRYPTO-TLS-001', 'tls_config', 'high', 'high', 'SSLv3', ''),
    Rule('CRYPTO-TLS-002', 'tls_config', 'high', 'high', 'TLSv1_0', ''),
    Rule('CRYPTO-TLS-003', 'tls_config', 'high', 'critical', 'verify=False', ''),
    Rule('CRYPTO-TLS-004', 'tls_config', 'high', 'critical', 'danger_accept_invalid_certs(true)', ''),
    Rule('CRYPTO-PWD-001', 'password_hash', 'high', 'critical', 'sha256(password', ''),
    Rule('CRYPTO-PWD-002', 'password_hash', 'high', 'critical', 'md5(password', ''),
)
ACCESS_CONTROL = (
    Rule('ACL-AUTH-001', 'missing_auth', 'high', 'high', '#[get(', ''),
    Rule('ACL-AUTH-002', 'missing_auth', 'high', 'high', 'app.route(', ''),
    Rule('ACL-AUTH-003', 'missing_auth', 'high', 'high', '@app.route(', ''),
    Rule('ACL-AUTH-004', 'missing_auth', 'high', 'high', 'router.get(', ''),
    Rule('ACL-AUTH-005', 'missing_auth', 'high', 'high', 'app.get(', ''),
    Rule('ACL-AUTH-006', 'missing_auth', 'high', 'high', 'r.GET(', ''),
    Rule('ACL-AUTH-007', 'missing_auth', 'high', 'high', '@RequestMapping', ''),
    Rule('ACL-AUTH-008', 'missing_auth', 'high', 'high', '@Path(', ''),
    Rule('ACL-CRED-001', 'hardcoded_creds', 'high', 'critical', 'password = "', ''),
    Rule('ACL-CRED-002', 'hardcoded_creds', 'high', 'critical', 'passwd = "', ''),
    Rule('ACL-CRED-003', 'hardcoded_creds', 'high', 'critical', 'secret = "', ''),
    Rule('ACL-CRED-004', 'hardcoded_creds', 'high', 'critical', 'api_key = "', ''),
    Rule('ACL-CRED-005', 'hardcoded_creds', 'high', 'critical', 'token = "', ''),
    Rule('ACL-CRED-006', 'hardcoded_creds', 'high', 'critical', 'admin:admin', ''),
    Rule('ACL-CRED-007', 'hardcoded_creds', 'high', 'critical', 'root:password', ''),
    Rule('ACL-CRED-008', 'hardcoded_creds', 'high', 'high', 'password = "password"', ''),
    Rule('ACL-CRED-009', 'hardcoded_creds', 'high', 'high', 'secret = "secret"', ''),
    Rule('ACL-IAM-001', 'iam_policy', 'high', 'critical', '"Effect": "Allow"', '"Resource": "*"'),
    Rule('ACL-IAM-002', 'iam_policy', 'high', 'critical', 'Effect: Allow', 'Resource: *'),
    Rule('ACL-IAM-003', 'iam_policy', 'high', 'high', '"Action": "*"', ''),
    Rule('ACL-IAM-004', 'iam_policy', 'high', 'high', 'Action: *', ''),
    Rule('ACL-CORS-001', 'cors', 'high', 'high', 'Access-Control-Allow-Origin: *', ''),
    Rule('ACL-CORS-002', 'cors', 'high', 'high', 'cors(allow_all=True)', ''),
    Rule('ACL-CORS-003', 'cors', 'high', 'medium', '@cross_origin(', ''),
    Rule('ACL-CORS-004', 'cors', 'high', 'medium', 'CORS(app', ''),
    Rule('ACL-SUDO-001', 'dangerous_shell', 'high', 'high', 'ALL=(ALL) NOPASSWD: ALL', ''),
    Rule('ACL-SUDO-002', 'dangerous_shell', 'high', 'medium', 'sudo su', ''),
)
SECRETS = (
    Rule('password_assign', 'secret', 'high', 'high', 'password', ''),
    Rule('passwd_assign', 'secret', 'high', 'high', 'passwd', ''),
    Rule('secret_key', 'secret', 'high', 'high', 'secret_key', ''),
    Rule('api_key', 'secret', 'high', 'high', 'api_key', ''),
    Rule('apikey', 'secret', 'high', 'high', 'apikey', ''),
    Rule('api_secret', 'secret', 'high', 'high', 'api_secret', ''),
    Rule('auth_token', 'secret', 'high', 'high', 'auth_token', ''),
    Rule('access_token', 'secret', 'high', 'high', 'access_token', ''),
    Rule('private_key', 'secret', 'high', 'high', 'private_key', ''),
    Rule('aws_secret', 'secret', 'high', 'high', 'aws_secret', ''),
    Rule('aws_access_key', 'secret', 'high', 'high', 'aws_access_key', ''),
    Rule('gh_token', 'secret', 'high', 'high', 'gh_token', ''),
    Rule('github_token', 'secret', 'high', 'high', 'github_token', ''),
    Rule('slack_token', 'secret', 'high', 'high', 'slack_token', ''),
    Rule('stripe_key', 'secret', 'high', 'high', 'stripe_key', ''),
    Rule('twilio_auth', 'secret', 'high', 'high', 'twilio_auth', ''),
    Rule('pem_header', 'secret', 'high', 'high', '-----BEGIN', ''),
    Rule('database_url', 'secret', 'high', 'medium', 'database_url', ''),
    Rule('db_password', 'secret', 'high', 'medium', 'db_password', ''),
    Rule('connection_string', 'secret', 'high', 'medium', 'connection_string', ''),
    Rule('jdbc_url', 'secret', 'high', 'medium', 'jdbc:', ''),
    Rule('smtp_password', 'secret', 'high', 'medium', 'smtp_password', ''),
    Rule('bearer_token', 'secret', 'high', 'medium', 'bearer ', ''),
)
ERRORS = (
    Rule('unwrap', 'error_handling', 'high', 'medium', '.unwrap()', ''),
    Rule('expect', 'error_handling', 'high', 'low', '.expect(', ''),
    Rule('panic', 'error_handling', 'high', 'high', 'panic!(', ''),
    Rule('panic', 'error_handling', 'high', 'high', 'panic!("', ''),
    Rule('unreachable', 'error_handling', 'high', 'low', 'unreachable!(', ''),
    Rule('todo', 'error_handling', 'high', 'medium', 'todo!()', ''),
    Rule('unimplemented', 'error_handling', 'high', 'medium', 'unimplemented!()', ''),
)
DEBT_TOOL = ("TODO", "FIXME", "HACK", "XXX", "WARN", "BUG", "OPTIMIZE")
DEBT_CHECK = ("TODO", "FIXME", "HACK", "XXX", "BUG")
# What registers authentication middleware, words of public routes (lower case), route calls.
AUTH_MIDDLEWARE = (
    ".layer(Auth", ".layer(auth", ".layer(require_auth", ".layer(RequireAuth", ".layer(Jwt", ".layer(jwt", ".layer(Token", ".layer(token", ".with_state(Auth",
    ".with_state(auth", "AuthLayer", "AuthMiddleware", "AuthenticationLayer", "AuthorizationLayer", "RequireAuthLayer", "JwtAuthLayer", "TokenAuthLayer",
    "RouteLayer::new(Auth", "route_layer(Auth", "route_layer(auth", "route_layer(RequireAuth",
    "@login_required", "@authenticate", "@permission_required", "@auth.", "login_required", "flask_login", "flask_security", "flask_principal", "flask_httpauth",
    "flask_jwt", "flask_jwt_extended", "LoginRequiredMixin", "PermissionRequiredMixin", "UserPassesTestMixin", "permission_required", "django.contrib.auth",
    "rest_framework.permissions", "IsAuthenticated", "IsAdminUser", "TokenAuthentication",
    "passport.authenticate", "passport.session", "express-jwt", "express-jwt-auth", "express-openid-connect", "authMiddleware", "auth_middleware",
    "authenticateToken", "verifyToken", "requireAuth", "isAuthenticated", "checkAuth", "@AuthGuard", "@RolesGuard", "@ThrottlerGuard", "@UseGuards(Auth", "@UseGuards(Jwt",
    "router.Use(auth", "router.Use(Auth", "r.Use(auth", "r.Use(Auth", "gin.BasicAuth", "gin.Auth", "middleware.BasicAuth", "middleware.JWT",
    "@EnableWebSecurity", "@EnableMethodSecurity", "SecurityFilterChain", ".authenticated()", ".permitAll()", ".hasRole(", ".hasAuthority(", "@PreAuthorize", "@Secured", "@RolesAllowed",
    "[Authorize]", "AddAuthentication(", "AddJwtBearer(", "UseAuthentication(", "UseAuthorization(",
)
PUBLIC_ROUTES = ("health", "ping", "status", "metrics", "favicon", "robots.txt", "openapi", "swagger", "docs", ".well-known")
ROUTE_METHODS = ("get(", "post(", "put(", "delete(", "patch(", "head(", "options(")
# Imports of structured logging.
LOG_IMPORTS = (
    "use tracing", "use log", "use slog", "use env_logger", "use log4rs", "import winston", "import pino", "import bunyan", "import structlog",
    '"go.uber.org/zap"', '"github.com/sirupsen/logrus"', "import logging", "org.slf4j", "org.apache.logging",
)
