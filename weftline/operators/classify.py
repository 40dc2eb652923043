"""Ordered first-match classification of steps.

A step is told by its name, else by its action (which never falls through to the command), else by its
command, first with the rules of the workflow's language. All rules are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.operators.labels import ACTIONS, DISPLAY, KEYWORDS, LABELS, LOCAL_ACTIONS

#: Label and the words that mark it in a step's name; stems are matched at the beginning of a word.
NAMES = (
    ("checkout_repository", "check ?out|clone"), ("setup_cache_service", "sccache|ccache"), ("manage_build_cache", "cache"), ("upload_coverage", "(upload|send|publish).*coverage"), ("generate_test_coverage", "coverage|codecov|coveralls"),
    ("publish_test_results", "(publish|upload|report).*test"), ("download_build_artifacts", "download.*(artifact|bundle)"), ("upload_build_artifacts", "(upload|archive|store).*(artifact|bundle|report|log)"), ("publish_release", "(create|draft|publish|make).*release|release notes"),
    ("publish_package", "(publish|push|upload).*(package|pypi|maven|npm|registry|crate)"), ("deploy_documentation", "deploy.*(doc|page|site)"), ("deploy_application", "deploy"), ("build_container_image", "(build|push).*(image|docker|container)|docker build"),
    ("build_documentation", "build.*doc|sphinx|doxygen|javadoc"), ("build_python_wheel", "wheel"), ("perform_security_analysis", "codeql|security|vulnerab|audit|trivy|snyk|scan"), ("static_analysis", "lint|format|style|flake8|ruff|mypy|clang-tidy|type ?check|static|pylint|checkstyle|spotbugs"),
    ("execute_benchmarks", "bench"), ("execute_tests", "test|pytest|ctest|junit|tox|smoke|suite"), ("install_system_dependencies", "apt(-get)? |brew |system (package|dep)"), ("setup_virtual_environment", "virtual ?env|venv|conda"),
    ("setup_runtime_environment", "set ?up.*(python|java|jdk|node|go|ruby|rust|runtime|toolchain)"), ("setup_build_environment", "set ?up|prepare|configure.*(compiler|msvc)"), ("install_project_dependencies", "install|dependenc|requirements|npm ci"),
    ("configure_build_profile", "configur|cmake -|preset"), ("build_package", "(build|create).*(package|dist|jar)|sdist|tar c"), ("compile_source_code", "compil|make( |$)|cmake --build|javac"), ("build_project", "build|mvn|gradle"), ("configure_secrets", "secret|credential|ssh|login|token"),
    ("configure_cloud_resources", "aws|azure|gcloud|terraform"), ("send_notification", "notif|slack|tell|announce"), ("manage_labels", "label"), ("clean_project_artifacts", "clean|remove|delete|prune|free.*space"), ("start_services", "start|launch|spin up"), ("stop_services", "stop|shut ?down|tear ?down"),
    ("inspect_environment", "version|print|show|display|environment|env$"), ("extract_version_metadata", "extract|metadata|determine|tag"), ("generate_changelog", "changelog"), ("collect_logs", "logs?( |$)"), ("execute_script", "script|bash |sh "), ("log_information", "echo|log"),
)
#: The same for commands, by tools and their verbs, and for those that mean something in one language only.
COMMANDS = (
    ("static_analysis", "pre-commit run|eslint|shellcheck|yamllint|prettier|markdownlint|hadolint|lint"), ("publish_test_results", "junit2html|allure generate"), ("generate_test_coverage", "codecov|coveralls|lcov|gcovr|--coverage|genhtml"),
    ("upload_build_artifacts", "aws s3 (cp|sync) [^|;]* s3://|gsutil (cp|rsync)|rclone copy|scp |rsync "), ("download_build_artifacts", "gh run download|aws s3 (cp|sync) s3://"), ("download_external_resources", "wget |curl [^|;]*-[a-z]*o|git lfs pull"),
    ("checkout_repository", "git clone|git submodule update"), ("switch_git_reference", "git (checkout|switch) "), ("deploy_infrastructure", "terraform apply|pulumi up"), ("destroy_infrastructure", "terraform destroy|pulumi destroy"),
    ("deploy_documentation", "mkdocs gh-deploy|ghp-import"), ("deploy_application", "kubectl (apply|rollout)|helm (upgrade|install)|serverless deploy|flyctl deploy|gcloud run deploy"), ("publish_package", "npm publish|docker push|cargo publish|conan upload"),
    ("publish_release", "gh release create|semantic-release|goreleaser"), ("publish_release_assets", "gh release upload|sha256sum "), ("perform_security_analysis", "trivy |grype |snyk |gitleaks|npm audit"), ("manage_build_cache", "ccache |sccache "),
    ("install_system_dependencies", "apt(-get)? install|yum install|dnf install|apk add|brew install|choco install|pacman -s"), ("install_project_dependencies", "npm (ci|install)|yarn install|pnpm install|bundle install|cargo fetch|go mod download|pip3? install|conan install|vcpkg install"),
    ("setup_package_manager", "corepack enable|bootstrap-vcpkg"), ("build_container_image", "docker (buildx )?build|podman build|buildah "), ("build_documentation", "mkdocs build|doxygen|jekyll build|hugo"), ("execute_tests", "ctest|pytest|tox|npm (run )?test|go test|cargo test|make (check|test)|(mvnw?|gradlew?) [^|;]*test"),
    ("configure_build_profile", "cmake -|\\./configure|meson setup|autoreconf"), ("compile_source_code", "cmake --build|make -j|make( |$)|ninja|gcc |g\\+\\+ |clang"), ("build_project", "npm run build|go build|cargo build|bazel build|mvnw? |gradlew? "), ("build_package", "tar c|zip -|cpack|npm pack"),
    ("send_notification", "hooks\\.slack|sendmail|notify-send"), ("configure_git_behavior", "git config"), ("configure_secrets", "gpg --import|ssh-(add|agent|keyscan)|docker login|chmod 600"), ("configure_cloud_resources", "aws configure|gcloud (auth|config)|az login"),
    ("export_environment_configuration", "github_(env|output|path)"), ("clean_project_artifacts", "rm -|docker system prune|make clean"), ("start_services", "docker(-| )compose up|systemctl start|service [a-z]+ start"), ("stop_services", "docker(-| )compose down|systemctl stop|kill "),
    ("inspect_environment", "--version|uname|printenv|env( |$)|ls( |$)|df -|free -|cat /proc"), ("log_information", "echo |printf "), ("execute_script", "bash |sh [a-z./]|\\./[a-z_./-]+\\.(sh|py|pl)"),
)
LANGUAGE_COMMANDS = {
    "Python": (
        ("generate_test_coverage", "pytest [^|;]*--cov|coverage (run|report|xml)"), ("execute_tests", "pytest|python -m unittest|tox|nox"), ("static_analysis", "flake8|pylint|mypy|ruff|black|isort|bandit"), ("install_project_dependencies", "pip3? install|poetry install|pipenv|uv (sync|pip)|conda install"),
        ("publish_package", "twine upload|poetry publish|flit publish"), ("build_package", "python -m build|setup\\.py (sdist|bdist)|poetry build"), ("setup_virtual_environment", "venv|virtualenv"),
    ),
    "Java": (
        ("static_analysis", "checkstyle|spotbugs|pmd|spotless"), ("publish_package", "mvnw? [^|;]*deploy|gradlew? [^|;]*publish"), ("execute_tests", "mvnw? [^|;]*(test|verify)|gradlew? [^|;]*(test|check)|ant test"), ("build_project", "mvnw? |gradlew? |ant "), ("compile_source_code", "javac "),
    ),
    "C++": (
        ("static_analysis", "clang-(tidy|format)|cppcheck|cpplint|include-what-you-use"), ("execute_tests", "ctest|valgrind"), ("install_project_dependencies", "vcpkg install|conan install"), ("setup_build_environment", "vcvarsall|update-alternatives|emsdk"), ("compile_source_code", "cmake --build|make|ninja|msbuild|g\\+\\+ "),
    ),
}
#: Of a text's pattern: it begins where no letter stands before, and its dots match every character. Java and RE2 agree on all of it.
_WORD = "(?s)(^|[^a-z])({})"


def name_rules(labels: list[str] = LABELS, own: tuple[tuple[str, str], ...] = NAMES) -> tuple[tuple[str, str], ...]:
    """(label, pattern) in order: `own` first, then each other label, marked by the stems of its words in their order."""
    known = {label for label, _ in own}
    rest = [(x, "[^a-z].*".join(w.removesuffix("s") + "[a-z]*" for w in x.split("_"))) for x in labels if x not in known]
    return tuple((label, _WORD.format(words.replace("( |$)", "( |\\z)").replace("env$", "env\\z"))) for label, words in (*own, *rest))


def command_rules(language: str | None = None) -> tuple[tuple[str, str], ...]:
    """(label, pattern) of commands in order: those of a language, or the general ones."""
    rules = COMMANDS if language is None else LANGUAGE_COMMANDS[language]
    return tuple((label, _WORD.format(words.replace("( |$)", "( |\\z)"))) for label, words in rules)


def action_rules() -> list[tuple[str, str, list[str]]]:
    """(label, test, words) for the slug of an action in order: begins with, is local and contains, is local, contains."""
    rules = [(label, "begins", [slug]) for slug, label in ACTIONS]
    rules += [(label, "local", [part]) for part, label in LOCAL_ACTIONS]
    return [*rules, ("composite", "local", [""]), *((label, "contains", words) for label, *words in KEYWORDS)]


def first_match(text: Column, rules: tuple[tuple[str, str], ...], otherwise: Column | None = None) -> Column:
    """The label of the first (label, pattern) found in the text; null for null. One CASE, compiled once per task."""
    out = F.lit(None).cast("string") if otherwise is None else otherwise
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def _plain(text: Column) -> Column:
    return F.lower(F.trim(text))


def classify_text(text: Column) -> Column:
    """The label that a text has as the name of a step; other without one."""
    return F.coalesce(first_match(_plain(text), name_rules()), F.lit("other"))


def classify_action(uses: Column) -> Column:
    """The label of an action by its slug: a known one, a local one, a word in it, else external_action; null for null."""
    slug = _plain(F.substring_index(uses, "@", 1))
    local = slug.startswith("./") | F.contains(slug, F.lit(".github/actions/"))
    out = F.when(uses.isNotNull(), "external_action")
    for label, test, words in reversed(action_rules()):
        found = F.lit(False)
        for w in words:
            found = found | (slug.startswith(w) if test == "begins" else F.contains(slug, F.lit(w)))
        out = F.when(local & found if test == "local" else found, F.lit(label)).otherwise(out)
    return out


def classify_command(run: Column, language: Column) -> Column:
    """The label of a command, by the rules of its language (Python, Java or C++), then by the general ones; null without one."""
    text = F.lower(run)
    out = first_match(text, command_rules())
    for known in LANGUAGE_COMMANDS:
        out = F.when(language == known, F.coalesce(first_match(text, command_rules(known)), out)).otherwise(out)
    return out


def classify_step(name: Column, uses: Column, run: Column, language: Column | None = None) -> Column:
    """The label of a step: by name, then by action, then by command; other without one."""
    by_command = classify_command(run, F.lit(None).cast("string") if language is None else language)
    return F.coalesce(first_match(_plain(name), name_rules()), classify_action(uses), by_command, F.lit("other"))


def shown(label: Column) -> Column:
    """The display name of a label: its words in title case, but for DISPLAY; what is no label stands for itself."""
    snake = F.contains(label, F.lit("_")) & (label == F.lower(label))
    out = F.when(snake, F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))).otherwise(label)
    for known, name in DISPLAY.items():
        out = F.when(label == known, name).otherwise(out)
    return out
