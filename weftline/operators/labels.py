"""The labels of steps and what is known of actions: fixed values, and nothing else."""

from __future__ import annotations

# The labels of steps, in the order in which a step's name is held against them.
LABELS = """
checkout_repository switch_git_reference setup_runtime_environment setup_runtime_tool setup_build_environment setup_package_manager configure_build_profile configure_documentation
configure_git_behavior configure_git_access setup_virtual_environment setup_base_environment setup_local_environment setup_network_connectivity setup_cache_service
install_project_dependencies install_external_tool install_dependencies_via_package_manager install_system_dependencies download_external_resources download_build_artifacts
compile_source_code build_container_image build_documentation build_static_site build_package build_python_wheel build_firmware build_library build_application build_project
deploy_infrastructure destroy_infrastructure generate_examples generate_build_configuration generate_build_files generate_network_model generate_documentation generate_access_token
generate_contribution_graph generate_filename prepare_build_artifacts execute_tests execute_cli_tests execute_network_test execute_benchmarks execute_script
execute_automation_script generate_test_coverage upload_coverage report_coverage upload_build_artifacts publish_artifacts publish_release_assets trigger_release_upload
publish_release publish_package deploy_documentation deploy_application static_analysis run_security_analysis initialize_security_analysis perform_security_analysis run_link_check
automated_code_fix publish_test_results inspect_environment inspect_logs inspect_platform_architecture inspect_repository_state extract_version_metadata extract_version_tag
extract_dependency_metadata extract_tool_version retrieve_dependency_metadata retrieve_toolchain_metadata record_commit_metadata export_environment_configuration configure_secrets
configure_cloud_resources verify_build_integrity check_version_consistency compare_version_metadata validate_outputs capture_test_output capture_messages process_output_files
collect_logs collect_debug_logs collect_service_logs collect_application_logs log_system_output log_workflow_message log_toolkit_message log_package_manager_info report_job_status
report_failure_information display_compiler_information display_system_information display_help_information send_notification notify_configuration_change generate_changelog
determine_release_status manage_labels manage_workflow_automation clean_project_artifacts trigger_external_upload_workflow skip_workflow prepare_build_environment
configure_system_timezone validate_release_consistency rename_build_artifact rename_artifact read_artifact_metadata adjust_file_permissions transfer_container_artifacts
define_helper_function define_target_platform define_target_platforms split_artifacts inject_cache_into_container archive_tool_cache transform_domain_data process_configuration
process_support_package terminate_session update_repository update_external_service start_services stop_services provision_runner decommission_runner manage_build_cache
orchestrate_workflow log_information
""".split()

# Labels whose display name is not their words in title case.
DISPLAY = {
    "compile_source_code": "Build Source Code",
    "execute_cli_tests": "Execute CLI Tests",
    "static_analysis": "Run Static Analysis",
    "inspect_environment": "Inspect Runtime Environment",
    "extract_version_metadata": "Generate Version Metadata",
    "configure_secrets": "Configure Secure Access",
    "install_dependencies_via_package_manager": "Install Dependencies via Package Manager",
    "inject_cache_into_container": "Inject Cache into Container",
    "run_benchmarks": "Execute Benchmarks",
}

# Labels that count as a setup, and as a build.
SETUP = """
setup_runtime_environment setup_build_environment setup_package_manager configure_build_profile setup_virtual_environment setup_base_environment setup_local_environment setup_cache_service
setup_network_connectivity setup_runtime_tool
""".split()
BUILD = """
build_project build_package build_application build_container_image build_static_site build_documentation compile_source_code build_firmware build_python_wheel build_library
""".split()

# Known actions and their labels. The first whose slug begins so holds.
ACTIONS = [
    line.split()
    for line in """
actions/checkout checkout_repository
actions/cache manage_build_cache
actions/upload-artifact upload_build_artifacts
actions/download-artifact download_build_artifacts
actions/create-release publish_release
actions/github-script execute_automation_script
actions/labeler manage_labels
actions/upload-pages-artifact upload_build_artifacts
actions/deploy-pages deploy_documentation
actions/configure-pages configure_build_profile
actions/setup-python setup_runtime_environment
actions/setup-java setup_runtime_environment
actions/setup-node setup_runtime_environment
actions/setup-go setup_runtime_environment
actions/setup-dotnet setup_runtime_environment
actions/setup-ruby setup_runtime_environment
step-security/harden-runner setup_build_environment
jwlawson/actions-setup-cmake setup_build_environment
seanmiddleditch/gha-setup-ninja setup_build_environment
kylemayers/install-llvm-action setup_build_environment
ilammy/msvc-dev-cmd setup_build_environment
egor-tensin/setup-mingw setup_build_environment
egor-tensin/setup-gcc setup_build_environment
microsoft/setup-msbuild setup_build_environment
docker/setup-buildx-action setup_build_environment
docker/setup-qemu-action setup_build_environment
sigstore/cosign-installer setup_build_environment
hondro/gtest-installer setup_build_environment
lukka/get-cmake setup_build_environment
mymindstorm/setup-emsdk setup_build_environment
browser-actions/setup-chrome setup_runtime_environment
nttld/setup-ndk setup_build_environment
lukka/run-vcpkg setup_package_manager
aminya/setup-vcpkg setup_package_manager
seanmiddleditch/vcpkg-action setup_package_manager
lukka/run-cmake build_project
gradle/gradle-build-action build_project
ralfg/python-wheels-manylinux-build build_python_wheel
calibreapp/image-actions build_project
actions/jekyll-build-pages build_static_site
ansys/actions/build-library build_library
snok/install-poetry install_project_dependencies
abatilo/actions-poetry install_project_dependencies
pytest-dev/pytest-action execute_tests
gradle/wrapper-validation-action verify_build_integrity
github/super-linter static_analysis
github/codeql-action/init initialize_security_analysis
github/codeql-action/autobuild build_project
github/codeql-action/analyze perform_security_analysis
github/codeql-action/upload-sarif perform_security_analysis
sonarsource/sonarcloud-github-action perform_security_analysis
snyk/actions perform_security_analysis
aquasecurity/trivy-action perform_security_analysis
actions/dependency-review-action perform_security_analysis
codecov/codecov-action generate_test_coverage
coverallsapp/github-action publish_release_assets
szenius/set-timezone configure_system_timezone
jupyter-server/jupyter_releaser/.github/actions/check-release-match validate_release_consistency
jupyterlab/maintainer-tools/.github/actions/upload-coverage upload_coverage
jupyterlab/maintainer-tools/.github/actions/report-coverage report_coverage
jupyterlab/maintainer-tools/.github/actions/base-setup setup_base_environment
jupyterlab/maintainer-tools/.github/actions/make-sdist setup_base_environment
jupyterlab/maintainer-tools/.github/actions/test-sdist setup_base_environment
jupyterlab/maintainer-tools/.github/actions/check-links run_link_check
softprops/action-gh-release publish_release
goreleaser/goreleaser-action publish_release
release-drafter/release-drafter publish_release
svenstaro/upload-release-action publish_release_assets
marvinpinto/action-automatic-releases publish_release
spring-io/nexus-sync-action publish_package
casperdcl/deploy-pypi publish_package
pypa/gh-action-pypi-publish publish_package
google-github-actions/deploy-cloudrun deploy_application
hashicorp/terraform-github-actions deploy_application
appleboy/ssh-action deploy_application
peaceiris/actions-gh-pages deploy_documentation
jamesives/github-pages-deploy-action deploy_documentation
crazy-max/ghaction-github-pages deploy_documentation
sphinx-notes/pages deploy_documentation
docker/build-push-action publish_release_assets
google-github-actions/auth configure_cloud_resources
aws-actions/configure-aws-credentials configure_cloud_resources
azure/login configure_cloud_resources
docker/login-action configure_cloud_resources
docker/metadata-action extract_version_metadata
hashicorp/setup-terraform setup_build_environment
andrew-chen-wang/github-wiki-action upload_build_artifacts
stefanzweifel/git-auto-commit-action upload_build_artifacts
platane/snk generate_contribution_graph
jungwinter/split split_artifacts
peter-evans/create-pull-request manage_workflow_automation
slackapi/slack-github-action send_notification
kolpav/purge-artifacts-action clean_project_artifacts
mattraks/delete-workflow-runs clean_project_artifacts
geekyeggo/delete-artifact clean_project_artifacts
actions/stale manage_workflow_automation
actions/first-interaction manage_workflow_automation
8bitjonny/gh-get-current-pr inspect_environment
cloudposse/github-action-matrix-outputs-read inspect_environment
scientific-python/action-towncrier-changelog generate_changelog
""".strip().splitlines()
]

# Parts of the path of a local action that tell its label.
LOCAL_ACTIONS = [[".github/actions/prepare_buildozer", "prepare_build_environment"], ["prepare_buildozer", "prepare_build_environment"]]

# Labels and the words in the slug of an unknown action that stand for them, tested in this order.
KEYWORDS = [
    ["static_analysis", "pre-commit", "super-linter", "semgrep", "sonar-scanner"],
    ["setup_runtime_environment", "setup-", "/setup", "install-llvm", "install-gcc", "install-cmake", "get-cmake", "get-ninja"],
    ["install_project_dependencies", "install-poetry", "install-uv", "install-pdm", "install-rust"],
    ["upload_build_artifacts", "auto-commit", "github-wiki"],
    ["deploy_documentation", "ghaction-github-pages"],
    ["publish_release", "upload-release", "release-drafter", "nexus-sync", "deploy-pypi"],
    ["publish_release", "release", "publish"],
    ["build_python_wheel", "manylinux-build", "build-wheels", "cibuildwheel"],
    ["deploy_application", "deploy"],
    ["execute_tests", "test", "spec"],
    ["static_analysis", "lint", "format", "style"],
    ["perform_security_analysis", "scan", "security", "vuln", "sast"],
    ["send_notification", "notify", "slack", "teams"],
    ["generate_test_coverage", "codecov", "coveralls", "coverall", "coverage-upload", "upload-coverage"],
    ["generate_test_coverage", "coverage"],
    ["upload_build_artifacts", "upload-artifact"],
    ["download_build_artifacts", "download-artifact"],
]
