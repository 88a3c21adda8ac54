"""Licence templates: notices as their licences ask for them, names, and SPDX tags."""

from __future__ import annotations

# Notices and opening words of public licences.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                  "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
                    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
                    "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
                    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
                    "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
                    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                    "derived from this software without specific prior written permission.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
               "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
            "The software is provided \"as is\" and the author disclaims all warranties",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                  "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mit": "Released under the MIT License",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                  "documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed "
             "as long as the name is changed",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
            "damages arising from the use of this software",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to "
               "the public domain worldwide",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
}

# Names of public licences by their SPDX id.
NAMES = {
    "afl-3.0": "Academic Free License version 3.0", "apache-1.1": "Apache License, Version 1.1", "apache-2.0": "Apache License, Version 2.0",
    "artistic-1.0": "Artistic License 1.0", "artistic-2.0": "Artistic License 2.0", "bsd-2-clause": "BSD 2-Clause License",
    "bsd-3-clause": "BSD 3-Clause License", "bsl-1.0": "Boost Software License, Version 1.0", "cc0-1.0": "CC0 1.0 Universal",
    "cddl-1.0": "Common Development and Distribution License 1.0", "cddl-1.1": "Common Development and Distribution License 1.1",
    "cecill-2.1": "CeCILL Free Software License Agreement version 2.1", "epl-1.0": "Eclipse Public License, version 1.0",
    "epl-2.0": "Eclipse Public License, version 2.0", "eupl-1.1": "European Union Public Licence, version 1.1",
    "eupl-1.2": "European Union Public Licence, version 1.2", "isc": "ISC License", "mpl-1.1": "Mozilla Public License, version 1.1",
    "mpl-2.0": "Mozilla Public License, version 2.0", "ms-pl": "Microsoft Public License", "ms-rl": "Microsoft Reciprocal License",
    "ncsa": "University of Illinois/NCSA Open Source License", "odbl-1.0": "Open Data Commons Open Database License version 1.0",
    "ofl-1.1": "SIL Open Font License, version 1.1", "openssl": "OpenSSL License", "php-3.01": "PHP License, version 3.01",
    "postgresql": "PostgreSQL License", "python-2.0": "Python License 2.0", "zlib": "zlib License", "zpl-2.1": "Zope Public License, version 2.1",
}
GNU = {"gpl": ("General Public License", ("1.0", "2.0", "3.0")), "lgpl": ("Lesser General Public License", ("2.1", "3.0")),
       "agpl": ("Affero General Public License", ("1.0", "3.0"))}
CREATIVE = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives",
            "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
#: Version of the Creative Commons licences, and the word after it.
CREATIVE_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
#: SPDX ids that only tags carry, besides those above.
TAGGED = ("MIT", "MIT-0", "0BSD", "BSD-4-Clause", "Unlicense", "WTFPL", "X11", "curl", "Vim", "BlueOak-1.0.0", "UPL-1.0")


def templates() -> dict[str, str]:
    """All templates; what follows ``#`` in a name tells several of one label apart."""
    out = dict(NOTICES)
    out |= {f"{label}#name": f"Licensed under the {name}" for label, name in NAMES.items()}
    ids = [*NAMES, *TAGGED]
    for kind, (name, versions) in GNU.items():
        for v in versions:
            number = v.removesuffix(".0")
            later = "gpl-notice" if (kind, v) == ("gpl", "3.0") else f"{kind}-{v}-or-later"
            out |= {f"{kind}-{v}#name": f"licensed under the GNU {name}, version {number}",
                    f"{later}#name": f"licensed under the GNU {name}, version {number} or later",
                    f"{later}#terms": f"under the terms of the GNU {name} as published by the Free Software Foundation, either version {number} "
                                      "of the License, or (at your option) any later version"}
            ids += [f"{kind}-{v}", f"{kind}-{v}-only", f"{kind}-{v}-or-later"]
    for kind, name in CREATIVE.items():
        for v, word in CREATIVE_VERSIONS.items():
            out |= {f"cc-{kind}#short-{v}": f"Licensed under CC {kind.upper()} {v}",
                    f"cc-{kind}#name-{v}": f"licensed under a Creative Commons {name} {v} {word} License"}
            ids.append(f"cc-{kind}-{v}")
    return out | {f"{i.lower().removesuffix('-only')}#{TAG}{i.lower()}": f"SPDX-License-Identifier: {i}" for i in ids}


TAG = "spdx:"
